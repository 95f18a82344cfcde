"""Shares of colours and sizes, overall and per store.

Grand totals are scalar subqueries over the already aggregated rows: one
number per total, no window without partition, no join. The input is read
more than once, so pass a stored report (``Contexto.resultado``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expresiones import porcentaje, sin_prefijo, texto_pct
from ..functions.tallas import ORDEN_TALLAS, posicion_talla
from ..params import CORTE_COLOR, CORTE_TALLA

CLAVES_COLOR = ("color", "color_hexa", "c_color")
TIENDA = ("ciudad", "local")


def _sumar(df: DataFrame, *claves: str) -> DataFrame:
    return df.groupBy(*claves).agg(
        F.sum("cant_venta").alias("cant_venta"), F.sum("cant_stock").alias("cant_stock")
    )


def _totales(df: DataFrame) -> Column:
    """Both grand totals as one subquery."""
    return df.agg(
        F.struct(F.sum("cant_venta").alias("venta"), F.sum("cant_stock").alias("stock"))
    ).scalar()


def _con_participacion_total(df: DataFrame, *, solo_positivo: bool = False) -> DataFrame:
    """Share of all units. With ``solo_positivo`` it is 0 unless the total is
    above zero, otherwise null where the total is zero."""
    suma = F.sum(F.col("cant_venta") + F.col("cant_stock"))
    si_cero = 0.0 if solo_positivo else None
    total = df.agg(F.when(suma > 0, suma) if solo_positivo else suma).scalar()
    return df.withColumn("total_unidades", F.col("cant_venta") + F.col("cant_stock")).withColumn(
        "pct_participacion_total", porcentaje(F.col("total_unidades"), total, si_cero)
    )


def _con_participaciones(df: DataFrame) -> DataFrame:
    """Share of sales and of stock in the rows that are left."""
    return (
        df.withColumn("totales", _totales(df))
        .withColumns(
            {
                "pct_participacion_venta": porcentaje(F.col("cant_venta"), F.col("totales.venta"), 0.0),
                "pct_participacion_stock": porcentaje(F.col("cant_stock"), F.col("totales.stock"), 0.0),
            }
        )
        .drop("totales")
    )


# --- colour ---------------------------------------------------------------------------


def participacion_color(por_color: DataFrame, min_pct: float = CORTE_COLOR) -> DataFrame:
    """Shades with at least ``min_pct`` of all units, and their share of the
    sales and stock of the shades that pass."""
    colores = _sumar(por_color.dropna(subset=list(CLAVES_COLOR)), *CLAVES_COLOR)
    relevantes = _con_participacion_total(colores, solo_positivo=True).where(F.col("pct_participacion_total") >= min_pct)
    return _con_participaciones(relevantes).orderBy(
        F.col("pct_participacion_total").desc(), F.col("pct_participacion_venta").desc()
    )


def colores_relevantes(por_color: DataFrame, min_pct: float = CORTE_COLOR) -> DataFrame:
    """Colour names of which at least one shade reaches ``min_pct`` of all
    units; unknown colours count in the total."""
    colores = _con_participacion_total(_sumar(por_color, *CLAVES_COLOR))
    return colores.where(F.col("pct_participacion_total") >= min_pct).select("color").distinct()


def participacion_color_tienda(por_color: DataFrame, min_pct: float = CORTE_COLOR) -> DataFrame:
    """Share of each shade in its store's sales and stock, over the relevant
    colour names. A store is a city and a name: equal names in two cities are
    two stores. Rows without colour cannot be shown and drop out before the
    semi join, which therefore needs no null-safe key."""
    sombras = _sumar(por_color.dropna(subset=list(CLAVES_COLOR)), *TIENDA, *CLAVES_COLOR)
    sombras = sombras.join(colores_relevantes(por_color, min_pct), "color", "left_semi")
    en_tienda = Window.partitionBy(*TIENDA)
    return sombras.withColumns(
        {
            "pct_participacion_venta": porcentaje(F.col("cant_venta"), F.sum("cant_venta").over(en_tienda), 0.0),
            "pct_participacion_stock": porcentaje(F.col("cant_stock"), F.sum("cant_stock").over(en_tienda), 0.0),
        }
    ).select(*TIENDA, *CLAVES_COLOR, "cant_venta", "cant_stock", "pct_participacion_venta", "pct_participacion_stock")


def titulos_tienda(participacion: DataFrame) -> DataFrame:
    """Title of each store's chart: its name and its city without the prefix."""
    titulo = F.concat("local", F.lit(" - "), sin_prefijo(F.col("ciudad")))
    return participacion.select(*TIENDA, titulo.alias("titulo")).distinct().orderBy(*TIENDA)


def etiquetas_color(participacion: DataFrame, grupo: Sequence[str] = ()) -> DataFrame:
    """Totals of the colour name on each of its shades, and label texts on the
    last shade of the name in display order. Overall that is share descending,
    then sale share descending, then colour code; within the charts that
    ``grupo`` names (``TIENDA``: one per store) colour, hex and code."""
    nombre = Window.partitionBy(*grupo, "color")
    al_final = (F.col("color_hexa").desc(), F.col("c_color").desc())
    if not grupo:
        al_final = (F.col("pct_participacion_total"), F.col("pct_participacion_venta"), *reversed(al_final))
    desde_abajo = nombre.orderBy(*al_final)
    medidas = ("pct_participacion_venta", "pct_participacion_stock", "cant_venta", "cant_stock")
    total = {f"{m}_grupo": F.sum(m).over(nombre) for m in medidas}
    ultima = F.row_number().over(desde_abajo) == 1
    return (
        participacion.withColumns(total)
        .withColumn("ultima", ultima)
        .withColumns(
            {
                f"texto_{m}": F.when(F.col("ultima"), texto_pct(F.col(f"pct_participacion_{m}_grupo"))).otherwise("")
                for m in ("venta", "stock")
            }
        )
        .withColumn("pct_orden", F.col("pct_participacion_venta_grupo") + F.col("pct_participacion_stock_grupo"))
        .orderBy(*grupo, "pct_orden", "color")
    )


# --- size -------------------------------------------------------------------------------


def orden_tallas(df: DataFrame, orden: Sequence[str] = ORDEN_TALLAS) -> DataFrame:
    """Adds ``posicion`` in the size order (null if not listed) and sorts the
    way the horizontal bars are drawn: last size first."""
    return df.withColumn("posicion", posicion_talla(F.col("talla"), orden)).orderBy(F.col("posicion").desc())


def participacion_talla(por_talla: DataFrame, orden: Sequence[str] = ORDEN_TALLAS) -> DataFrame:
    """Size curve: share of each listed size in the sales and stock of the
    listed sizes."""
    tallas = _sumar(por_talla, "talla").withColumn("posicion", posicion_talla(F.col("talla"), orden))
    listadas = tallas.where(F.col("posicion").isNotNull())
    return _con_participaciones(listadas).orderBy(F.col("posicion").desc())


def etiquetas_talla(participacion: DataFrame) -> DataFrame:
    """Label texts of both bars of every size."""
    return participacion.withColumns(
        {f"texto_{m}": texto_pct(F.col(f"pct_participacion_{m}")) for m in ("venta", "stock")}
    )


def tallas_relevantes(por_talla: DataFrame, min_pct: float = CORTE_TALLA) -> DataFrame:
    """Sizes with at least ``min_pct`` of all units, null and unlisted ones
    included."""
    tallas = _con_participacion_total(_sumar(por_talla, "talla"))
    return tallas.where(F.col("pct_participacion_total") >= min_pct).select("talla")


def participacion_talla_tienda(
    por_talla: DataFrame,
    colores: Sequence[str] = (),
    min_pct: float = CORTE_TALLA,
    orden: Sequence[str] = ORDEN_TALLAS,
) -> DataFrame:
    """Size curve of each store with the same sizes everywhere: a size the
    store does not have appears with zeros.

    Each store's cells are gathered in a map with at most one entry per listed
    size and read back along the common curve, so no store x size product is
    joined. The curve itself is a list no longer than ``orden``.
    """
    if colores:
        por_talla = por_talla.where(F.col("color").isin(list(colores)))
    posicion = posicion_talla(F.col("talla"), orden)
    relevantes = tallas_relevantes(por_talla, min_pct)
    curva = (
        relevantes.withColumn("posicion", posicion)
        .where(F.col("posicion").isNotNull())
        .agg(F.collect_list(F.struct("posicion", "talla")))
        .scalar()
    )
    relevantes = relevantes.withColumnRenamed("talla", "talla_relevante")
    celdas = (
        _sumar(por_talla, *TIENDA, "talla")
        .join(relevantes, F.col("talla").eqNullSafe(F.col("talla_relevante")), "left_semi")
        .withColumn("listada", posicion.isNotNull())
    )
    entrada = F.struct("talla", F.struct("cant_venta", "cant_stock"))
    tiendas = celdas.groupBy(*TIENDA).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("listada"), entrada))).alias("celdas"),
        F.sum(F.when(F.col("listada"), F.col("cant_venta"))).alias("venta_tienda"),
        F.sum(F.when(F.col("listada"), F.col("cant_stock"))).alias("stock_tienda"),
    )
    densa = (
        tiendas.withColumn("curva", curva)
        .select("*", F.inline("curva"))
        .withColumn("celda", F.try_element_at("celdas", F.col("talla")))
    )
    cantidad = {m: F.coalesce(F.col(f"celda.{m}"), F.lit(0).cast("bigint")) for m in ("cant_venta", "cant_stock")}
    return (
        densa.select(
            *TIENDA,
            "talla",
            "posicion",
            *(c.alias(m) for m, c in cantidad.items()),
            porcentaje(cantidad["cant_venta"], F.col("venta_tienda"), 0.0).alias("pct_participacion_venta"),
            porcentaje(cantidad["cant_stock"], F.col("stock_tienda"), 0.0).alias("pct_participacion_stock"),
        )
        .orderBy(*TIENDA, F.col("posicion").desc())
    )
