"""Small derived tables, written once to a folder every executor can reach.

Writing cuts the lineage (lost executors re-read a file instead of redoing the
joins) and measures the table on the way, so that a later join knows whether
its side may be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMITE_DIFUSION = 64 * 1024 * 1024
BYTES_POR_CAMPO = 16  # slot and padding of a field in memory, besides its text


def carpeta_compartida(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else a folder below its warehouse."""
    carpeta = spark.conf.get("spark.checkpoint.dir", None)
    return carpeta or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_vitrina"


@dataclass(frozen=True)
class Medida:
    """A table with its measured rows and bytes per column; ``bytes_`` is None
    when nothing was measured."""

    df: DataFrame
    filas: int | None = None
    bytes_: Mapping[str, int] | None = None
    limite: int = LIMITE_DIFUSION

    @property
    def difundible(self) -> bool:
        return self.bytes_ is not None and sum(self.bytes_.values()) <= self.limite

    def de(self, *columnas: str) -> "Medida":
        """Only these columns, with their part of the measure: what a join
        does not need does not count against the limit."""
        bytes_ = self.bytes_ and {c: self.bytes_[c] for c in columnas}
        return replace(self, df=self.df.select(*columnas), bytes_=bytes_)

    def solo(self, df: DataFrame) -> "Medida":
        """A filter of this table that keeps few rows, measured by itself."""
        textos = [c.name for c in df.schema if isinstance(c.dataType, T.StringType)]
        fila = df.agg(F.count(F.lit(1)).alias("filas"), *(F.sum(F.octet_length(c)).alias(c) for c in textos)).first()
        bytes_ = {c: fila["filas"] * BYTES_POR_CAMPO + ((fila[c] or 0) if c in textos else 0) for c in df.columns}
        return replace(self, df=df, filas=fila["filas"], bytes_=bytes_)

    def lado(self, df: DataFrame | None = None) -> DataFrame:
        """This table (or a filter of it) as a join side: broadcast if measured
        small enough, else left to Spark, which sorts and merges or re-plans
        from runtime sizes."""
        df = self.df if df is None else df
        return F.broadcast(df) if self.difundible else df


class Almacen:
    """Writes and measures tables below the session's shared folder."""

    def __init__(self, spark: SparkSession, limite: int = LIMITE_DIFUSION):
        self.spark = spark
        self.limite = limite
        self.raiz = f"{carpeta_compartida(spark)}/vitrina-{uuid.uuid4().hex}"

    def guardar(self, nombre: str, df: DataFrame, *, medir: bool = True) -> Medida:
        return self.escribir(self.ruta_nueva(nombre), df, medir=medir)

    def escribir(self, ruta: str, df: DataFrame, *, medir: bool = True) -> Medida:
        """Write a table to this path, measure it on the way and read it back."""
        escrito = self.spark.read.schema(df.schema)
        if not medir:
            df.write.parquet(ruta)
            return Medida(escrito.parquet(ruta), limite=self.limite)
        medicion = Observation()
        textos = [c.name for c in df.schema if isinstance(c.dataType, T.StringType)]
        df.observe(
            medicion,
            F.count(F.lit(1)).alias("filas"),
            *(F.expr(f"sum(octet_length({c})) as {c}") for c in textos),
        ).write.parquet(ruta)
        medido = medicion.get
        filas = medido["filas"]
        bytes_ = {
            c: filas * BYTES_POR_CAMPO + ((medido[c] or 0) if c in textos else 0) for c in df.columns
        }
        return Medida(escrito.parquet(ruta), filas, bytes_, self.limite)

    def ruta_nueva(self, nombre: str) -> str:
        return f"{self.raiz}/{nombre}-{uuid.uuid4().hex}"

    def borrar(self) -> None:
        """Delete every table of this store."""
        ruta = self.spark._jvm.org.apache.hadoop.fs.Path(self.raiz)
        ruta.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(ruta, True)

