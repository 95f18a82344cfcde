"""Sales-and-stock reports over the two facts.

All share one shape: both facts, pruned to client and dates, become one stream
of movements; the item table (already joined with the valid groups), the
stores and the calendar are looked up; one aggregation yields the report.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import (
    corte_semanal,
    en_rangos,
    lunes,
    precio_medio,
    precio_no_cero,
    precio_o_cero,
    sin_prefijo,
)
from ..operators.articulos import con_programa, marca_efectiva
from ..operators.calientes import separar
from ..operators.filtros import Seleccion, filtros_dinamicos
from ..operators.grupos import CLAVES, con_grupos, grupos_validos
from ..operators.hechos import GRANO, MEDIDAS, consolidar, movimientos_stock, movimientos_venta, por_semana
from ..params import SEMANAS_DEFECTO, Rango, Ventana, VentanaAnual, VentanaReciente, en_semanas, lunes_de_etiqueta
from ..sources.almacen import Medida
from .contexto import COLUMNAS_ARTICULO, COLUMNAS_COLOR, Contexto

# Item columns every report needs: the key and what makes up its group.
ATRIBUTOS = ("ean", "marca_calc", "tipo_calc", "fit_calc")
TIPO_TIENDA = "TIENDA"
# Fixed value: the longest city name shown in a store label.
LARGO_CIUDAD = 20


# --- building blocks -------------------------------------------------------------


def movimientos(
    ctx: Contexto, cliente: str, ventas: Sequence[Rango], stock: Sequence[Rango]
) -> DataFrame:
    return ctx.fuente.movimientos(cliente, ventas, stock)


def grupos_del_dia(ctx: Contexto, cliente: str, dia: date, umbral: int) -> DataFrame:
    """Groups whose stock on one snapshot day, over stores of any type,
    reaches the threshold."""
    articulos = ctx.articulos(cliente).de(*ATRIBUTOS)
    stock = movimientos(ctx, cliente, [], [(dia, dia)])
    if not articulos.difundible:
        stock = consolidar(stock, ["ean"])
    return grupos_validos(stock.join(articulos.lado(), "ean", "left"), umbral)


def grupos_medidos(ctx: Contexto, cliente: str, dia: date, umbral: int) -> Medida:
    """The valid groups as a small table, shared by all reports that measure
    them on the same day."""
    return ctx.una_vez(
        ("grupos", cliente, dia, umbral), lambda: grupos_del_dia(ctx, cliente, dia, umbral)
    )


def articulos_con_grupos(
    ctx: Contexto, cliente: str, grupos: Medida, how: str, columnas: Sequence[str] = ()
) -> Medida:
    """Items with their valid group and the given further columns, joined at
    catalogue grain. A group is unique and repeats the item's own values, so
    the item table does not grow and the measure stays a bound."""
    color = not set(COLUMNAS_COLOR).isdisjoint(columnas)
    articulos = ctx.articulos(cliente, color).de(*ATRIBUTOS, *columnas)
    bytes_ = articulos.bytes_ and {
        **articulos.bytes_,
        **{g: articulos.bytes_[a] for g, a in zip(CLAVES, ATRIBUTOS[1:])},
    }
    return replace(articulos, df=con_grupos(articulos.df, grupos.lado(), how), bytes_=bytes_)


def con_articulos(movs: DataFrame, articulos: Medida, how: str = "left", calientes: Sequence[str] = ()) -> DataFrame:
    """Item attributes. Rows of the hot items meet a broadcast of their few
    catalogue rows, if these are measured small; the rest join without a hint."""
    if not calientes:
        return movs.join(articulos.lado(), "ean", how)
    (de_moda, resto), (pocos, otros) = (separar(df, "ean", calientes) for df in (movs, articulos.df))
    if not articulos.solo(pocos).difundible:
        return movs.join(articulos.df, "ean", how)
    return de_moda.join(F.broadcast(pocos), "ean", how).unionByName(resto.join(otros, "ean", how))


def con_tienda(ctx: Contexto, cliente: str, df: DataFrame, *, solo_tiendas: bool = True) -> DataFrame:
    """Store attributes. ``solo_tiendas`` keeps only locations of the store
    type; otherwise unknown stores stay with nulls."""
    tiendas = ctx.tiendas(cliente)
    locales = tiendas.df
    if solo_tiendas:
        locales = locales.where(F.col("tipo_tienda") == TIPO_TIENDA)
    return (
        df.join(tiendas.lado(locales.drop("tipo_tienda")), "num_local", "inner" if solo_tiendas else "left")
        .withColumn("ini_cliente", F.lit(cliente))
        .withColumnRenamed("num_local", "c_l")
    )


def enriquecer(ctx: Contexto, cliente: str, movs: DataFrame) -> DataFrame:
    """Movements row by row with the attributes of item and store."""
    return con_tienda(ctx, cliente, con_articulos(movs, ctx.articulos(cliente).de(*ATRIBUTOS)))


def con_semana(ctx: Contexto, df: DataFrame) -> DataFrame:
    """Calendar columns of the week of ``fecha``; null labels for weeks the
    calendar does not know."""
    semanas = ctx.semanas()
    return df.withColumn("lunes", lunes(F.col("fecha"))).join(semanas.lado(), "lunes", "left")


def _base(
    ctx: Contexto,
    cliente: str,
    movs: DataFrame,
    dia: date,
    umbral: int,
    *,
    how: str,
    columnas: Sequence[str] = (),
    solo_tiendas: bool = True,
    por_articulo: bool = False,
    medidas: Sequence[str] = MEDIDAS,
    calientes: Callable[[], Sequence[str]] = tuple,
) -> DataFrame:
    """Movements with every attribute a report groups by, ``columnas`` of the
    item among them; ``dia`` and ``umbral`` decide which brand groups are
    valid.

    Facts are consolidated first when the report keeps the item
    (``por_articulo``) or when a dimension is too large to broadcast. In the
    latter case they are summed again once the item is no longer needed, so
    that neither a hot item nor a hot store or week can skew a join. Items that
    hold more rows than a task should (``calientes``) are looked up in a
    broadcast of just these items; the others are sorted and merged.
    """
    ctx.preparar(cliente, color=not set(COLUMNAS_COLOR).isdisjoint(columnas))
    grupos = grupos_medidos(ctx, cliente, dia, umbral)
    articulos = articulos_con_grupos(ctx, cliente, grupos, how, columnas)
    difundidas = all(m.difundible for m in (articulos, ctx.tiendas(cliente), ctx.semanas()))
    if por_articulo or not difundidas:
        if how == "inner" and articulos.difundible:
            # Items outside the valid groups need not be shuffled at all.
            movs = movs.join(articulos.lado(articulos.df.select("ean")), "ean", "left_semi")
        movs = consolidar(movs, medidas=medidas)
    df = con_articulos(movs, articulos, how, () if articulos.difundible else calientes())
    if not (por_articulo or difundidas):
        df = consolidar(df, [c for c in df.columns if c not in ("ean", *medidas)], medidas)
    return con_semana(ctx, con_tienda(ctx, cliente, df, solo_tiendas=solo_tiendas))


def _como(solo_validas: bool) -> str:
    return "inner" if solo_validas else "left"


def _unidades() -> list[Column]:
    return [F.sum("cant_venta").alias("cant_venta"), F.sum("cant_stock").alias("cant_stock")]


def _base_ventana(
    ctx: Contexto,
    p: Ventana,
    solo_validas: bool,
    *,
    tienda: str | None = None,
    semanas: Sequence[date] | None = None,
    **opciones,
) -> DataFrame:
    """``tienda`` and the Mondays in ``semanas`` limit the facts that are read."""
    rangos = [[r] if semanas is None else en_semanas(r, semanas) for r in (p.rango_ventas, p.rango_stock)]
    movs = por_semana(movimientos(ctx, p.cliente, *rangos))
    if tienda is not None:
        movs = movs.where(F.col("num_local") == tienda)
    return _base(
        ctx,
        p.cliente,
        movs,
        p.fecha_fin,
        p.umbral,
        how=_como(solo_validas),
        calientes=lambda: ctx.articulos_calientes(p.cliente, *rangos),
        **opciones,
    )


# --- by store, colour, size ----------------------------------------------------------


def agrupar_por_tienda(base: DataFrame) -> DataFrame:
    return base.groupBy(
        "ini_cliente",
        "c_l",
        "local",
        "ciudad",
        F.col("vmt_marca").alias("marca"),
        F.col("vmt_tipo").alias("tipo_programa"),
        F.col("vmt_fit").alias("fit_estilo"),
        "semanas",
    ).agg(
        *_unidades(),
        precio_o_cero(F.sum("importe"), F.sum("cant_venta")).alias("pvp_prom"),
    )


def agrupar_por_color(base: DataFrame) -> DataFrame:
    return base.groupBy(
        "ini_cliente",
        F.col("tipo_calc").alias("tipo_programa"),
        "c_l",
        "local",
        "ciudad",
        F.col("vmt_marca").alias("marca"),
        "semanas",
        F.col("vmt_fit").alias("fit_estilo"),
        "color",
        F.col("cod_color").alias("c_color"),
        "color_hexa",
    ).agg(*_unidades())


def agrupar_por_talla(base: DataFrame) -> DataFrame:
    return base.groupBy(
        "ini_cliente",
        F.col("tipo_calc").alias("tipo_programa"),
        "c_l",
        "local",
        "ciudad",
        F.col("vmt_marca").alias("marca"),
        "semanas",
        F.col("vmt_fit").alias("fit_estilo"),
        F.concat("color", F.lit("-"), "cod_color").alias("color"),
        "talla",
    ).agg(*_unidades())


def ventas_por_tienda(ctx: Contexto, p: Ventana, *, solo_validas: bool = False) -> DataFrame:
    """Units sold, units in stock and mean price by store, brand, programme,
    fit and week. Rows of groups below the threshold have a null brand, or are
    left out with ``solo_validas``."""
    return agrupar_por_tienda(_base_ventana(ctx, p, solo_validas))


def ventas_por_color(ctx: Contexto, p: Ventana, *, solo_validas: bool = False) -> DataFrame:
    """Units by store, brand, programme, fit, week and colour."""
    return agrupar_por_color(
        _base_ventana(ctx, p, solo_validas, columnas=("cod_color", "color", "color_hexa"))
    )


def ventas_por_talla(ctx: Contexto, p: Ventana, *, solo_validas: bool = False) -> DataFrame:
    """Units by store, brand, programme, fit, week, colour and size."""
    return agrupar_por_talla(
        _base_ventana(ctx, p, solo_validas, columnas=("cod_color", "color", "talla"))
    )


# --- the summary page ------------------------------------------------------------------

_COMUNES = ("ini_cliente", "c_l", "local", "ciudad", "vmt_marca", "vmt_fit", "semanas")
_CONJUNTOS = {
    "tienda": ("vmt_tipo",),
    "color": ("tipo_calc", "color", "cod_color", "color_hexa"),
    "talla": ("tipo_calc", "color_talla", "talla"),
}
# Measures of the page: stock and row counts of the store report's window and of the last week.
_MEDIDAS_PAGINA = ("cant_venta", "cant_stock", "stock_semana", "importe", "n_tienda", "n_semana")
_COLUMNAS_INFORME = {
    "tienda": ("ini_cliente", "c_l", "local", "ciudad", "marca", "tipo_programa", "fit_estilo", "semanas", "cant_venta", "cant_stock", "pvp_prom"),
    "color": ("ini_cliente", "tipo_programa", "c_l", "local", "ciudad", "marca", "semanas", "fit_estilo", "color", "c_color", "color_hexa", "cant_venta", "cant_stock"),
    "talla": ("ini_cliente", "tipo_programa", "c_l", "local", "ciudad", "marca", "semanas", "fit_estilo", "color", "talla", "cant_venta", "cant_stock"),
}


def pagina_resumen(ctx: Contexto, p: Ventana, *, solo_validas: bool = False) -> DataFrame:
    """The reports by store, colour and size of one page, told apart by
    ``informe``, from one pass over both facts: one enriched stream, one
    aggregation over three grouping sets. Colour and size look at the last
    seven days of stock only, so their stock is a sum of its own, and a group
    is theirs if it has sales or stock of these days."""
    corta = p.ultima_semana_de_stock()
    movs = movimientos(ctx, p.cliente, [p.rango_ventas], [p.rango_stock, corta.rango_stock])
    en_tienda, en_semana = (F.expr(en_rangos("fecha", [r])) for r in (p.rango_stock, corta.rango_stock))
    cero = F.lit(0)
    movs = movs.select(
        *GRANO,
        "cant_venta",
        F.when(en_tienda, F.col("cant_stock")).otherwise(cero).alias("cant_stock"),
        F.when(en_semana, F.col("cant_stock")).otherwise(cero).alias("stock_semana"),
        "importe",
        (F.col("n_venta") + F.when(en_tienda, F.col("n_stock")).otherwise(cero)).alias("n_tienda"),
        (F.col("n_venta") + F.when(en_semana, F.col("n_stock")).otherwise(cero)).alias("n_semana"),
    )
    base = _base(
        ctx,
        p.cliente,
        por_semana(movs),
        p.fecha_fin,
        p.umbral,
        how=_como(solo_validas),
        columnas=("cod_color", "color", "color_hexa", "talla"),
        medidas=_MEDIDAS_PAGINA,
        calientes=lambda: ctx.articulos_calientes(p.cliente, [p.rango_ventas], [p.rango_stock, corta.rango_stock]),
    ).withColumn("color_talla", F.concat("color", F.lit("-"), "cod_color"))
    conjuntos = {n: [*_COMUNES, *propias] for n, propias in _CONJUNTOS.items()}
    claves = list(dict.fromkeys(c for conjunto in conjuntos.values() for c in conjunto))
    informe = F.when(F.grouping("vmt_tipo") == 0, "tienda").when(F.grouping("talla") == 0, "talla").otherwise("color")
    sumas = base.groupingSets(list(conjuntos.values()), *claves).agg(
        informe.alias("informe"),
        *[F.sum(m).alias(m) for m in _MEDIDAS_PAGINA],
        precio_o_cero(F.sum("importe"), F.sum("cant_venta")).alias("precio"),
    )
    de_tienda = F.col("informe") == "tienda"
    return sumas.where(F.when(de_tienda, F.col("n_tienda")).otherwise(F.col("n_semana")) > 0).select(
        "informe",
        "ini_cliente",
        "c_l",
        "local",
        "ciudad",
        F.col("vmt_marca").alias("marca"),
        F.when(de_tienda, F.col("vmt_tipo")).otherwise(F.col("tipo_calc")).alias("tipo_programa"),
        F.col("vmt_fit").alias("fit_estilo"),
        "semanas",
        F.when(F.col("informe") == "talla", F.col("color_talla")).otherwise(F.col("color")).alias("color"),
        F.col("cod_color").alias("c_color"),
        "color_hexa",
        "talla",
        "cant_venta",
        F.when(de_tienda, F.col("cant_stock")).otherwise(F.col("stock_semana")).alias("cant_stock"),
        F.when(de_tienda, F.col("precio")).alias("pvp_prom"),
    )


def informes_de_pagina(ctx: Contexto, p: Ventana, *, solo_validas: bool = False) -> dict[str, DataFrame]:
    """The three reports of the page by name, computed and stored together."""
    pagina = ctx.resultado(pagina_resumen, p, solo_validas=solo_validas)
    return {n: pagina.where(F.col("informe") == n).select(*columnas) for n, columnas in _COLUMNAS_INFORME.items()}


# --- item grain -------------------------------------------------------------------------


def detalle_filtrado(
    ctx: Contexto,
    p: Ventana,
    *,
    tienda: str | None = None,
    semanas: Sequence[str] | None = None,
    selecciones: Seleccion | None = None,
) -> DataFrame:
    """Detail of valid groups for one store and the user's selections. Weeks
    are chosen by the label of the other pages; store and weeks limit what is
    read of the facts, the rest is selected on the finished rows."""
    elegidas = None if semanas is None else [lunes_de_etiqueta(s) for s in semanas]
    detalle = ventas_stock_detalle(ctx, p, solo_validas=True, tienda=tienda, semanas=elegidas)
    return filtros_dinamicos(detalle, selecciones or {})


def ventas_stock_detalle(
    ctx: Contexto,
    p: Ventana,
    *,
    solo_validas: bool = False,
    tienda: str | None = None,
    semanas: Sequence[date] | None = None,
) -> DataFrame:
    """Store x item x week detail for export, over locations of any type.

    The aggregation after the joins keeps store, item and week among its keys,
    so it runs on the partitioning the consolidation left behind.
    """
    base = _base_ventana(
        ctx,
        p,
        solo_validas,
        columnas=[c for c in (*COLUMNAS_ARTICULO, *COLUMNAS_COLOR) if c not in ATRIBUTOS],
        solo_tiendas=False,
        por_articulo=True,
        tienda=tienda,
        semanas=semanas,
    )
    sku_madre = ctx.sku_madre()
    base = base.join(sku_madre.lado(), "ean", "left")
    return (
        _separar_codigo_color(base)
        .groupBy(
            "ini_cliente",
            "c_l",
            "local",
            "ciudad",
            "ean",
            "sku",
            "sku_madre",
            F.col("descripcion_nueva").alias("descripcion"),
            F.col("ref_modelo").alias("modelo"),
            F.col("vmt_marca").alias("marca"),
            "subclase",
            F.col("tipo_calc").alias("tipo_programa"),
            F.col("fit_calc").alias("fit_estilo"),
            "color",
            "cod_color",
            "color_hexa",
            "talla",
            "fecha",
            F.col("semanas_lunes").alias("semanas"),
        )
        .agg(
            *_unidades(),
            precio_no_cero(F.sum("importe"), F.sum("cant_venta")).alias("pvp_prom"),
        )
    )


def _separar_codigo_color(df: DataFrame) -> DataFrame:
    """Stock carries the colour table's code (null if unknown), sales the
    item's own: an unknown colour therefore has a row for each."""
    cero = F.lit(0).cast("bigint")
    partes = F.array(
        F.struct(
            F.col("codigo").alias("cod_color"),
            cero.alias("cant_venta"),
            F.col("cant_stock"),
            F.lit(0).cast(df.schema["importe"].dataType).alias("importe"),
            F.col("n_stock").alias("n"),
        ),
        F.struct(
            F.col("cod_color"),
            F.col("cant_venta"),
            cero.alias("cant_stock"),
            F.col("importe"),
            F.col("n_venta").alias("n"),
        ),
    )
    resto = [c for c in df.columns if c not in ("codigo", "cod_color", *MEDIDAS)]
    return df.select(*resto, F.inline(partes)).where(F.col("n") > 0).drop("n")


def ventas_stock_8sem(ctx: Contexto, p: VentanaReciente) -> DataFrame:
    """Store x item x week over the last eight weeks, valid groups only; the
    groups are measured on this week's Monday."""
    movs = por_semana(movimientos(ctx, p.cliente, [p.rango], [p.rango]))
    base = _base(
        ctx,
        p.cliente,
        movs,
        p.lunes,
        p.umbral,
        how="inner",
        columnas=("sku", "ref_modelo"),
        solo_tiendas=False,
        por_articulo=True,
        calientes=lambda: ctx.articulos_calientes(p.cliente, [p.rango], [p.rango]),
    )
    return base.groupBy(
        "ini_cliente",
        "c_l",
        "local",
        "ean",
        "sku",
        F.col("ref_modelo").alias("modelo"),
        F.col("vmt_marca").alias("marca"),
        F.col("tipo_calc").alias("tipo_programa"),
        "fecha",
        F.col("semanas_lunes").alias("semanas"),
    ).agg(
        *_unidades(),
        precio_medio(F.sum("importe"), F.sum("cant_venta")).alias("pvp_prom"),
    )


# --- this year against last ---------------------------------------------------------------


def ventas_sem_ano(ctx: Contexto, p: VentanaAnual, *, solo_validas: bool = False) -> DataFrame:
    """Daily sales and stock of the last weeks and of the same span one year
    before. Stock of groups below the threshold is left out; their sales stay,
    with a null brand, unless ``solo_validas``."""
    rangos = p.rangos(p.semanas_venta), p.rangos(p.semanas_stock)
    base = _base(
        ctx,
        p.cliente,
        movimientos(ctx, p.cliente, *rangos),
        p.corte,
        p.umbral,
        how=_como(solo_validas),
        calientes=lambda: ctx.articulos_calientes(p.cliente, *rangos),
    )
    return _agrupar_sem_ano(base if solo_validas else _solo_stock_valido(base))


def _solo_stock_valido(base: DataFrame) -> DataFrame:
    valido = F.col("vmt_marca").isNotNull()
    return base.where(valido | (F.col("n_venta") > 0)).withColumn(
        "cant_stock", F.when(valido, F.col("cant_stock")).otherwise(F.lit(0))
    )


def _agrupar_sem_ano(base: DataFrame, *mas: str) -> DataFrame:
    ciudad = F.substring(sin_prefijo(F.col("ciudad")), 1, LARGO_CIUDAD)
    return base.groupBy(
        *mas,
        "ini_cliente",
        F.col("tipo_calc").alias("tipo_programa"),
        "c_l",
        F.concat(ciudad, F.lit(" - "), "local").alias("tienda"),
        F.col("vmt_marca").alias("marca"),
        "fecha",
        "n_sem",
        "ano",
    ).agg(*_unidades())


# --- several windows at once ------------------------------------------------------------------


def dias_de_ventanas(ventanas: DataFrame, semanas_venta: int, semanas_stock: int) -> DataFrame:
    """Every day that the windows of (ini_cliente, as_of) rows look at:
    ini_cliente, corte, fecha and whether sales and stock of the day count. Two
    spans a window: the weeks up to its cut-off, and those one calendar year
    before."""
    corte = corte_semanal(F.col("as_of"))
    cortes = ventanas.select("ini_cliente", corte.alias("corte")).distinct()
    finales = F.array(F.col("corte"), F.add_months("corte", -12))
    tramos = cortes.select("ini_cliente", "corte", F.explode(finales).alias("fin"))
    atras = 7 * max(semanas_venta, semanas_stock)
    dias = tramos.select("ini_cliente", "corte", "fin", F.explode(F.sequence(F.date_sub("fin", atras), F.col("fin"))).alias("fecha"))
    return dias.groupBy("ini_cliente", "corte", "fecha").agg(
        F.max(F.col("fecha") >= F.date_sub("fin", 7 * semanas_venta)).alias("en_venta"),
        F.max(F.col("fecha") >= F.date_sub("fin", 7 * semanas_stock)).alias("en_stock"),
    )


def ventas_sem_ano_varias(
    ctx: Contexto,
    ventanas: DataFrame,
    *,
    umbral: int,
    semanas_venta: int = SEMANAS_DEFECTO,
    semanas_stock: int = SEMANAS_DEFECTO,
    solo_validas: bool = False,
) -> DataFrame:
    """``ventas_sem_ano`` for many (ini_cliente, as_of) rows in one run, told
    apart by ``corte``.

    The windows become a small table of days that the facts join by client and
    day, so folders of other days are pruned at run time by its values; a line
    is read once, whatever the number of windows it falls in.
    """
    dias = ctx.almacen.guardar("ventanas", dias_de_ventanas(ventanas, semanas_venta, semanas_stock))
    claves = ["ini_cliente", "fecha"]
    # The comparison holds for every row; it tells Spark that the side selects.
    pasados = dias.df.where("fecha <= corte")
    por_cliente = ("ini_cliente", "corte", *GRANO)

    def en_ventanas(hecho: str, dentro: Column) -> DataFrame:
        return ctx.fuente.tabla(hecho).join(dias.lado(pasados.where(dentro).select(*claves, "corte")), claves)

    ventas = movimientos_venta(en_ventanas("dwh_ventas", F.col("en_venta")), por_cliente)
    stock = movimientos_stock(en_ventanas("dwh_stock", F.col("en_stock")), por_cliente)
    articulos = _articulos_de_clientes(ctx)
    del_corte = movimientos_stock(en_ventanas("dwh_stock", F.col("fecha") == F.col("corte")), por_cliente)
    grupos = (
        articulos(del_corte)
        .groupBy("ini_cliente", "corte", *[F.col(a).alias(g) for a, g in zip(ATRIBUTOS[1:], CLAVES)])
        .agg(F.sum("cant_stock").alias("stock_grupo"))
        .where(F.col("stock_grupo") >= umbral)
        .select(F.col("ini_cliente").alias("g_cliente"), F.col("corte").alias("g_corte"), *CLAVES)
    )
    grupos = ctx.almacen.guardar("grupos-ventanas", grupos)
    tiendas = ctx.una_vez(
        ("tiendas-todas",),
        lambda: ctx.fuente.tabla("tiendas").where(F.col("tipo") == TIPO_TIENDA).select("ini_cliente", F.col("codigo").alias("num_local"), "local", "ciudad"),
    )
    movs = articulos(consolidar(ventas.unionByName(stock), por_cliente))
    valido = (
        (F.col("ini_cliente") == F.col("g_cliente"))
        & (F.col("corte") == F.col("g_corte"))
        & (F.col("marca_calc") == F.col("vmt_marca"))
        & (F.col("tipo_calc") == F.col("vmt_tipo"))
        & F.col("fit_calc").eqNullSafe(F.col("vmt_fit"))
    )
    base = con_semana(ctx, movs.join(grupos.lado(), valido, _como(solo_validas)).join(tiendas.lado(), ["ini_cliente", "num_local"]))
    if not solo_validas:
        base = _solo_stock_valido(base)
    return _agrupar_sem_ano(base.withColumnRenamed("num_local", "c_l"), "corte")


def _articulos_de_clientes(ctx: Contexto) -> Callable[[DataFrame], DataFrame]:
    """Looks up brand, programme and fit of movements of several clients. Only
    the brand depends on the client, by its exceptions per subclass."""
    comunes = ctx.una_vez(("articulos-todos",), lambda: _articulos_comunes(ctx))
    excepciones = ctx.tabla("marca_subclase")
    propias = excepciones.lado(
        excepciones.df.select("ini_cliente", F.col("subcategoria").alias("subclase"), F.col("marca").alias("marca_excepcion"))
    )

    def buscar(movs: DataFrame) -> DataFrame:
        df = movs.join(comunes.lado(), "ean", "left").join(propias, ["ini_cliente", "subclase"], "left")
        return df.withColumn("marca_calc", F.coalesce("marca_excepcion", "marca_comun")).drop("marca_excepcion", "marca_comun", "subclase")

    return buscar


def _articulos_comunes(ctx: Contexto) -> DataFrame:
    sin_excepcion = ctx.tabla("marca_subclase").df.limit(0)
    con_marca = marca_efectiva(ctx.fuente.tabla("cat_sku"), sin_excepcion, ctx.tabla("marca").lado(), "")
    con_tipo = con_programa(con_marca, ctx.tabla("monitoreo").lado())
    return con_tipo.select("ean", "subclase", F.col("marca_calc").alias("marca_comun"), "tipo_calc", "fit_calc")
