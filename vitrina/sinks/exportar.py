"""Report files and the timing log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

ESQUEMA_TIEMPOS = "momento timestamp, consulta string, escala string, segundos double"
_OPCIONES = {"csv": {"header": "true"}, "parquet": {}}


def exportar(
    df: DataFrame,
    ruta: str,
    formato: str = "parquet",
    particion: Sequence[str] = (),
    modo: str = "errorifexists",
) -> DataFrame:
    """Write a report as files, one writer per partition, and return it as
    read back. With ``particion`` the rows are rebalanced on those columns
    first: large values are split over several files, small ones merged."""
    if particion:
        df = df.hint("rebalance", *particion)
    opciones = _OPCIONES[formato]
    df.write.format(formato).options(**opciones).mode(modo).partitionBy(*particion).save(ruta)
    leido = df.sparkSession.read.format(formato).options(**opciones).schema(df.schema).load(ruta)
    return leido.select(*df.columns)


def registrar_tiempos(spark: SparkSession, filas: Iterable[tuple], ruta: str) -> None:
    """Append timings (moment, query, scale, seconds) to the log table."""
    spark.createDataFrame(list(filas), ESQUEMA_TIEMPOS).coalesce(1).write.mode("append").parquet(ruta)
