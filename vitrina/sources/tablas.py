"""Where the ten tables come from.

A source hands out lazy DataFrames. Fact readers take the client and the date
ranges of the report, so that each storage can turn them into partition or
file pruning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expresiones import en_rangos
from ..operators.hechos import unir_movimientos
from ..params import Rango
from ..schemas import ESQUEMAS, HECHOS
from .diaria import TablaDiaria, resumir


class Fuente:
    """Base source: subclasses provide :meth:`tabla`."""

    spark: SparkSession

    def tabla(self, nombre: str) -> DataFrame:
        raise NotImplementedError

    def ventas(self, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        """Sales rows of one client, or of all, inside any of the date ranges."""
        return self._hechos("dwh_ventas", cliente, rangos)

    def stock(self, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        """Stock snapshot rows of one client, or of all, inside any of the date ranges."""
        return self._hechos("dwh_stock", cliente, rangos)

    def _hechos(self, nombre: str, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        return de_cliente(self.tabla(nombre), cliente).where(en_rangos("fecha", rangos))

    def movimientos(self, cliente: str, ventas: Sequence[Rango], stock: Sequence[Rango]) -> DataFrame:
        """Sales and stock of one client as one stream, each inside its own ranges."""
        return unir_movimientos(self.ventas(cliente, ventas), self.stock(cliente, stock))

    def dias(self, nombre: str) -> DataFrame:
        """Rows and hash sum per day and client of a fact table. Sources that
        keep this beside the facts read it from there."""
        return resumir(self.tabla(nombre))

    def guarda_dias(self, nombre: str) -> bool:
        """Whether ``dias`` is read from a stored summary."""
        return False


def _con_esquema(df: DataFrame, nombre: str) -> DataFrame:
    return df.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in ESQUEMAS[nombre]))


def de_cliente(hechos: DataFrame, cliente: str | None) -> DataFrame:
    return hechos if cliente is None else hechos.where(F.col("ini_cliente") == cliente)


class FuenteTablas(Fuente):
    """Tables read by name: Parquet folders, a catalog schema or a database."""

    def __init__(
        self, spark: SparkSession, leer: Callable[[str], DataFrame], diaria: Callable[[str], TablaDiaria] | None = None
    ):
        self.spark = spark
        self._leer = leer
        self._diaria = diaria

    def tabla(self, nombre: str) -> DataFrame:
        return _con_esquema(self._leer(nombre), nombre)

    def _hechos(self, nombre: str, cliente: str | None, rangos: Sequence[Rango]) -> DataFrame:
        if not self.guarda_dias(nombre):
            return super()._hechos(nombre, cliente, rangos)
        df = _con_esquema(self._diaria(nombre).leer_dias(rangos), nombre)
        return de_cliente(df, cliente).where(en_rangos("fecha", rangos))

    def guarda_dias(self, nombre: str) -> bool:
        return self._diaria is not None and self._diaria(nombre).existe

    def dias(self, nombre: str) -> DataFrame:
        return self._diaria(nombre).dias() if self.guarda_dias(nombre) else super().dias(nombre)

    @classmethod
    def parquet(cls, spark: SparkSession, raiz: str) -> "FuenteTablas":
        """``raiz/<table>``; facts partitioned by ``fecha`` prune by folder, and
        the summary of their days is read where it was written.
        With very many files prefer a catalog, which lists only the partitions
        a report needs."""
        return cls(
            spark, lambda n: spark.read.parquet(f"{raiz}/{n}"), lambda n: TablaDiaria(spark, f"{raiz}/{n}")
        )

    @classmethod
    def catalogo(cls, spark: SparkSession, esquema: str = "dbo") -> "FuenteTablas":
        return cls(spark, lambda n: spark.table(f"{esquema}.{n}"))

    @classmethod
    def jdbc(
        cls,
        spark: SparkSession,
        url: str,
        *,
        fechas: Rango,
        particiones: int = 64,
        esquema: str = "dbo",
        opciones: Mapping[str, str] | None = None,
    ) -> "FuenteTablas":
        """Database tables. Facts are read in parallel slices of ``fecha``
        between the two given dates; filters on client and date are pushed to
        the database by Spark."""

        def leer(nombre: str) -> DataFrame:
            lector = spark.read.format("jdbc").options(
                **opciones_jdbc(nombre, url, fechas, particiones, esquema, opciones)
            )
            return lector.load()

        return cls(spark, leer)


def opciones_jdbc(
    nombre: str,
    url: str,
    fechas: tuple[date, date],
    particiones: int,
    esquema: str,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    opciones = {"url": url, "dbtable": f"{esquema}.{nombre}", "fetchsize": "10000", **(extra or {})}
    if nombre in HECHOS:
        opciones |= {
            "partitionColumn": "fecha",
            "lowerBound": fechas[0].isoformat(),
            "upperBound": fechas[1].isoformat(),
            "numPartitions": str(particiones),
        }
    return opciones


def escribir_hechos(df: DataFrame, ruta: str) -> TablaDiaria:
    """Write a fact table in the layout the reports prune on, with the summary
    of its days beside it. The result takes later changes."""
    tabla = TablaDiaria(df.sparkSession, ruta)
    tabla.crear(df)
    return tabla
