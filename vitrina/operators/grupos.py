"""Brand / programme / fit groups with enough stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAVES = ("vmt_marca", "vmt_tipo", "vmt_fit")


def grupos_validos(stock_enriquecido: DataFrame, umbral: int) -> DataFrame:
    """Groups whose stock reaches the threshold. Null is a group like any
    other; the result has one row per group."""
    return (
        stock_enriquecido.groupBy(
            F.col("marca_calc").alias("vmt_marca"),
            F.col("tipo_calc").alias("vmt_tipo"),
            F.col("fit_calc").alias("vmt_fit"),
        )
        .agg(F.sum("cant_stock").alias("stock_grupo"))
        .where(F.col("stock_grupo") >= umbral)
        .drop("stock_grupo")
    )


def con_grupos(df: DataFrame, grupos: DataFrame, how: str = "left") -> DataFrame:
    """Join on brand and type by ``=`` and on fit null-safely, so that items
    without a fit keep their group."""
    return df.join(
        grupos,
        (F.col("marca_calc") == F.col("vmt_marca"))
        & (F.col("tipo_calc") == F.col("vmt_tipo"))
        & F.col("fit_calc").eqNullSafe(F.col("vmt_fit")),
        how,
    )


def ventas_validas(reporte: DataFrame) -> DataFrame:
    """Drop the report rows whose group missed the threshold."""
    return reporte.dropna(subset=["marca"])
