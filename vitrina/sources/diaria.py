"""Fact tables in folders by day, with a summary of their days beside them.

The summary has a row per day and client: how many rows there are, and the sum
of their hashes. Both add up, so the bounds of the dates, the clients, the size
of any window and the days that differ from an earlier state are known without
reading the facts. A day that is removed takes its clients with it.

A change is made in this order: the days it touches are noted, the facts are
written, the summary of these days is taken from the stored files (of a new
table, from the rows that were written), the next version of the summary is written, the note goes. Versions are written whole and
count once they carry Spark's success mark. After a crash the note is still
there: readers then take the noted days from the facts, and the next change
begins by summing them up again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expresiones import en_rangos
from ..params import Rango
from .carpetas import Carpetas

ESQUEMA_DIAS = T.StructType(
    [
        T.StructField("fecha", T.DateType()),
        T.StructField("ini_cliente", T.StringType()),
        T.StructField("filas", T.LongType()),
        T.StructField("huella", T.DecimalType(38, 0)),
    ]
)
CARPETAS_POR_NOMBRE = 400  # folders that are named one by one; more come from a listing
_DECIMAL_LARGO = "decimal(20,0)"


def resumir(hechos: DataFrame) -> DataFrame:
    """Rows and hash sum of every day and client; partial sums on the map side.
    Rows without a date belong to no day and to no report."""
    columnas = sorted(hechos.columns)
    return hechos.where("fecha is not null").groupBy("fecha", "ini_cliente").agg(
        F.count(F.lit(1)).alias("filas"),
        F.sum(F.xxhash64(*columnas).cast(_DECIMAL_LARGO)).cast("decimal(38,0)").alias("huella"),
    )


def dias_de(df: DataFrame) -> list[date]:
    """The days of a frame. A value a day, however large the facts are."""
    filas = df.select("fecha").where("fecha is not null").distinct().toLocalIterator()
    return sorted(f.fecha for f in filas)


def leer_carpetas(spark: SparkSession, ruta: str, esquema: T.StructType | str | None, dias: Sequence[date]) -> DataFrame:
    """The folders of these days of a table, without listing the others unless
    they are a long span: then the folders are pruned from one listing."""
    if not dias:
        return spark.read.parquet(ruta).limit(0) if esquema is None else spark.createDataFrame([], esquema)
    lector = spark.read.option("basePath", ruta)
    if esquema is not None:
        lector = lector.schema(esquema)
    if len(dias) > CARPETAS_POR_NOMBRE:
        return lector.parquet(ruta).where(F.col("fecha").between(dias[0], dias[-1]))
    return lector.parquet(*(f"{ruta}/fecha={d.isoformat()}" for d in dias))


class TablaDiaria:
    """The facts at ``ruta`` and their summary at ``ruta`` + ``_dias``."""

    def __init__(self, spark: SparkSession, ruta: str):
        self.spark = spark
        self.ruta = ruta
        self.carpetas = Carpetas(spark, f"{ruta}_dias")

    @property
    def existe(self) -> bool:
        return self.carpetas.ultima("dias") is not None

    def leer(self) -> DataFrame:
        return self.spark.read.parquet(self.ruta)

    def leer_dias(self, rangos: Sequence[Rango]) -> DataFrame:
        """Rows of the days in these ranges. Their folders are known from the
        summary, so no others are listed, however many days there are."""
        presentes = self.dias().where(en_rangos("fecha", rangos))
        return leer_carpetas(self.spark, self.ruta, self._esquema(), dias_de(presentes))

    def _esquema(self) -> T.StructType:
        """Of the whole table, from the files of its last day."""
        guardados = self._leer_dias(self.carpetas.ultima("dias"))
        ultimo = guardados.agg(F.max("fecha")).first()[0]
        return leer_carpetas(self.spark, self.ruta, None, [ultimo] if ultimo else []).schema

    def dias(self) -> DataFrame:
        """fecha, ini_cliente, filas, huella. Reads no facts, but for days of a
        change that never ended."""
        version = self.carpetas.ultima("dias")
        guardados = self._leer_dias(version)
        pendientes = self._pendientes()
        if not pendientes:
            return guardados
        return self._al_dia(guardados, pendientes)

    # --- changes ------------------------------------------------------------------

    def crear(self, df: DataFrame) -> None:
        """Write the table. ``rebalance`` lets AQE split days with many rows and merge small ones."""
        df.hint("rebalance", "fecha").write.mode("errorifexists").partitionBy("fecha").parquet(self.ruta)
        self._guardar_dias(resumir(df))

    def agregar(self, df: DataFrame) -> None:
        """Append rows, to new days or to known ones."""
        self._cambiar(df, "append")

    def reescribir(self, df: DataFrame) -> None:
        """The days that occur in ``df`` get its rows instead of theirs; other days are not touched."""
        self._cambiar(df, "overwrite")

    def quitar(self, dias: Iterable[date]) -> None:
        """Remove whole days."""
        dias = sorted(set(dias))
        anteriores = self._anotar(dias)
        for dia in dias:
            self.carpetas.borrar(f"{self.ruta}/fecha={dia.isoformat()}")
        self._resumir_de_nuevo(sorted({*dias, *anteriores}))

    def _cambiar(self, df: DataFrame, modo: str) -> None:
        dias = dias_de(df)
        anteriores = self._anotar(dias)
        escritor = df.hint("rebalance", "fecha").write.mode(modo).partitionBy("fecha")
        if modo == "overwrite":
            escritor = escritor.option("partitionOverwriteMode", "dynamic")
        escritor.parquet(self.ruta)
        self._resumir_de_nuevo(sorted({*dias, *anteriores}))

    # --- summary --------------------------------------------------------------------

    def _anotar(self, dias: Sequence[date]) -> list[date]:
        """Note the days of a change; the days that a change before left open."""
        abiertos = self._pendientes()
        todos = sorted({*dias, *abiertos})
        filas = self.spark.createDataFrame([(d,) for d in todos], "fecha date")
        self.carpetas.escribir(filas.coalesce(1), "pendiente")
        return abiertos

    def _pendientes(self) -> list[date]:
        nota = self.carpetas.ultima("pendiente")
        if nota is None:
            return []
        return sorted(f.fecha for f in self.spark.read.schema("fecha date").parquet(nota).toLocalIterator())

    def _resumir_de_nuevo(self, dias: Sequence[date]) -> None:
        version = self.carpetas.ultima("dias")
        self._guardar_dias(self._al_dia(self._leer_dias(version), dias))
        self.carpetas.borrar_todas("pendiente")

    def _al_dia(self, guardados: DataFrame, dias: Sequence[date]) -> DataFrame:
        """The summary with these days taken from the facts."""
        otros = guardados.where(~F.col("fecha").isin(list(dias)))
        tocados = [d for d in dias if self.carpetas.existe(f"{self.ruta}/fecha={d.isoformat()}")]
        if not tocados:
            return otros
        nuevos = resumir(leer_carpetas(self.spark, self.ruta, None, tocados))
        return otros.unionByName(nuevos.select(*otros.columns))

    def _leer_dias(self, version: str | None) -> DataFrame:
        if version is None:
            return resumir(self.leer()).select(*ESQUEMA_DIAS.names)
        return self.spark.read.schema(ESQUEMA_DIAS).parquet(version)

    def _guardar_dias(self, dias: DataFrame) -> None:
        # A row a day and client: one file, so that readers open one.
        self.carpetas.escribir(dias.select(*ESQUEMA_DIAS.names).coalesce(1), "dias")
