"""Store summary: roll-up, indicators of the last week, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import razon, texto_pct

CLAVES_RESUMEN = ("ini_cliente", "marca", "tipo_programa", "fit_estilo", "semanas")


def resumen_todas_tiendas(por_tienda: DataFrame, *, keep_null_fit: bool = False) -> DataFrame:
    """Store report rolled up over its stores. The mean price weighs the
    stores' rounded prices and rounds half to even. Rows with a null key drop
    out, except a null fit with ``keep_null_fit``."""
    obligatorias = [c for c in CLAVES_RESUMEN if not (keep_null_fit and c == "fit_estilo")]
    venta = F.sum("cant_venta")
    return (
        por_tienda.dropna(subset=obligatorias)
        .groupBy(*CLAVES_RESUMEN)
        .agg(
            venta.alias("cant_venta"),
            F.sum("cant_stock").alias("cant_stock"),
            F.bround(razon(F.sum(F.col("pvp_prom") * F.col("cant_venta")), venta), 0).alias("pvp_prom"),
        )
    )


def kpis_ultima_semana(resumen: DataFrame) -> DataFrame:
    """One row with the indicators of the latest week. Weeks are summed first
    and the latest kept afterwards, so the report is computed once."""
    por_semana = (
        resumen.where(F.col("semanas").isNotNull())
        .groupBy("semanas")
        .agg(
            F.sum("cant_venta").alias("venta"),
            F.sum("cant_stock").alias("stock"),
            F.sum(F.col("pvp_prom") * F.col("cant_venta")).alias("importe"),
        )
    )
    ultima = por_semana.agg(
        *(F.max_by(c, "semanas").alias(c) for c in ("venta", "stock", "importe")),
        F.max("semanas").alias("semana"),
    ).fillna(0, ["venta", "stock", "importe"])
    venta, total = F.col("venta"), F.col("venta") + F.col("stock")
    return ultima.select(
        "semana",
        venta.alias("venta_unidades"),
        F.col("stock").alias("stock_unidades"),
        F.when(total > 0, venta / total * 100).otherwise(0.0).alias("sell_through"),
        F.when(venta > 0, F.col("importe") / venta).otherwise(0.0).alias("pvp_ponderado"),
    )


def textos_kpi(kpis: DataFrame) -> DataFrame:
    """The indicators as display texts."""
    return kpis.select(
        "semana",
        F.format_number("venta_unidades", 0).alias("venta"),
        F.format_number("stock_unidades", 0).alias("stock"),
        texto_pct(F.col("sell_through")).alias("sell_through"),
        F.concat(F.lit("$ "), F.format_number("pvp_ponderado", 0)).alias("pvp"),
    )


def detalle_semanas_evacuacion(reporte: DataFrame) -> DataFrame:
    """Report rows with the weeks the stock lasts at the week's pace."""
    return reporte.withColumn("sem_evac", razon(F.col("cant_stock"), F.col("cant_venta"))).orderBy(
        "fit_estilo", "semanas"
    )


def subtotales_marca(reporte: DataFrame) -> DataFrame:
    """Sales and stock subtotals of each brand."""
    return reporte.groupBy("marca").agg(
        F.sum("cant_venta").alias("cant_venta"), F.sum("cant_stock").alias("cant_stock")
    )


def detalle_por_marca(reporte: DataFrame) -> DataFrame:
    """The grid as one table: detail rows (``nivel`` 0) under their brand's
    subtotal (``nivel`` 1), by brand, fit and week. Both levels are grouping
    sets of one aggregation, so the report is read once; its rows are unique,
    as those of any report are."""
    claves = [c for c in reporte.columns if c not in ("cant_venta", "cant_stock")]
    niveles = reporte.groupingSets([claves, ["marca"]], *claves).agg(
        F.sum("cant_venta").alias("cant_venta"),
        F.sum("cant_stock").alias("cant_stock"),
        F.grouping("semanas").cast("int").alias("nivel"),
    )
    evacuacion = F.when(F.col("nivel") == 0, razon(F.col("cant_stock"), F.col("cant_venta")))
    return niveles.select(*reporte.columns, evacuacion.alias("sem_evac"), "nivel").orderBy(
        "marca", F.col("nivel").desc(), "fit_estilo", "semanas"
    )
