"""Movements at store x item x day, refreshed by day.

All measures of the reports are sums, so they are answered from these sums with
the same rows, and a window costs a row per store, item and day however many
lines the facts hold. Attributes of items, stores and weeks are looked up by the
reports as ever, so a corrected brand or colour needs no refresh.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import en_rangos
from ..operators.calientes import separar, valores_calientes
from ..operators.hechos import GRANO, MEDIDAS, consolidar, movimientos_stock, movimientos_venta
from ..params import Rango
from ..schemas import HECHOS
from .carpetas import Carpetas
from .diaria import dias_de, leer_carpetas
from .tablas import Fuente, de_cliente

CLAVES = ("ini_cliente", *GRANO)
ESQUEMA = (
    "ini_cliente string, num_local string, ean string, fecha date, cant_venta long, cant_stock long,"
    " importe decimal(33,2), n_venta long, n_stock long"
)
FILAS_POR_TAREA = 1_000_000  # rows of the facts that one task sums in memory
MAS_PARTES = 1024  # finest share of the rows that a frequent key is looked for by
_CAMPOS = ("filas", "huella")
_ESTADO = tuple(f"{campo}_{hecho}" for hecho in HECHOS for campo in _CAMPOS)


@dataclass(frozen=True)
class Refresco:
    """Days whose folder was written, and days that went."""

    escritos: Sequence[date]
    quitados: Sequence[date]


@dataclass(frozen=True)
class Reparto:
    """Which tasks sum a day: ``cuantas`` of them from number ``primera`` on."""

    fecha: date
    primera: int
    cuantas: int


def repartir(filas: Mapping[date, int], por_tarea: int, llenar: int) -> list[Reparto]:
    """Days in order, several in a task while their rows are at most ``llenar``;
    a day of more than ``por_tarea`` rows gets tasks of its own."""
    repartos: list[Reparto] = []
    tarea, ocupadas = -1, llenar
    for dia, suyas in sorted(filas.items()):
        if suyas > por_tarea:
            cuantas = -(-suyas // por_tarea)
            repartos.append(Reparto(dia, tarea + 1, cuantas))
            tarea, ocupadas = tarea + cuantas, llenar
            continue
        if tarea < 0 or ocupadas + suyas > llenar:
            tarea, ocupadas = tarea + 1, 0
        repartos.append(Reparto(dia, tarea, 1))
        ocupadas += suyas
    return repartos


def en_tramos(dias: Iterable[date]) -> list[Rango]:
    """The days as ranges without gaps."""
    tramos: list[Rango] = []
    for dia in sorted(dias):
        if tramos and dia - tramos[-1][1] == timedelta(days=1):
            tramos[-1] = (tramos[-1][0], dia)
        else:
            tramos.append((dia, dia))
    return tramos


class Mart(Fuente):
    """A source whose movements come from the sums stored at ``ruta``.

    ``refrescar`` compares the summary of the facts' days with the one the mart
    was last written from, and rewrites the folders of the days that differ, no
    others. Folders are replaced whole and the state is written last, so after a
    crash the next refresh writes the same days again.
    """

    def __init__(self, base: Fuente, ruta: str):
        self.spark = base.spark
        self.base = base
        self.ruta = ruta
        self.carpetas = Carpetas(self.spark, f"{ruta}_estado")

    def tabla(self, nombre: str) -> DataFrame:
        return self.base.tabla(nombre)

    def dias(self, nombre: str) -> DataFrame:
        return self.base.dias(nombre)

    def guarda_dias(self, nombre: str) -> bool:
        return self.base.guarda_dias(nombre)

    def leer(self) -> DataFrame:
        return self.spark.read.schema(ESQUEMA).parquet(self.ruta)

    def movimientos(self, cliente: str, ventas: Sequence[Rango], stock: Sequence[Rango]) -> DataFrame:
        """Rows whose sales or stock lie in their ranges; what lies outside
        counts as zero. Only the folders of these days are listed."""
        rangos = en_rangos("fecha", [*ventas, *stock])
        estado = self.spark.read.parquet(self.carpetas.ultima("estado"))
        leidos = leer_carpetas(self.spark, self.ruta, ESQUEMA, dias_de(estado.where(rangos)))
        leidos = de_cliente(leidos, cliente).where(rangos)
        en_venta, en_stock = (F.expr(en_rangos("fecha", r)) for r in (ventas, stock))
        medidas = [
            F.when(en_stock if m.endswith("stock") else en_venta, F.col(m)).otherwise(F.lit(0).cast(leidos.schema[m].dataType)).alias(m)
            for m in MEDIDAS
        ]
        return leidos.select(*GRANO, *medidas).where("n_venta > 0 or n_stock > 0")

    # --- refresh ----------------------------------------------------------------------

    def refrescar(self) -> Refresco:
        """Bring the days that changed since the last refresh up to date."""
        previsto = self.spark.read.parquet(self.carpetas.escribir(self._estado_de_los_hechos().coalesce(1), "previsto"))
        ultimo = self.carpetas.ultima("estado")
        antes = previsto.limit(0) if ultimo is None else self.spark.read.schema(previsto.schema).parquet(ultimo)
        escritos, quitados = self._diferencias(previsto, antes)
        if escritos or ultimo is None:
            self._sumas(escritos).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "fecha"
            ).parquet(self.ruta)
        for dia in quitados:
            self.carpetas.borrar(f"{self.ruta}/fecha={dia.isoformat()}")
        if escritos or quitados or ultimo is None:
            self.carpetas.escribir(previsto.coalesce(1), "estado")
        return Refresco(sorted(escritos), quitados)

    def _estado_de_los_hechos(self) -> DataFrame:
        """Per day the rows and the hash sum of each fact table."""
        por_hecho = [
            self.base.dias(n).select("fecha", *[F.col(c).cast("decimal(38,0)").alias(f"{c}_{n}") for c in _CAMPOS])
            for n in HECHOS
        ]
        juntos = por_hecho[0].unionByName(por_hecho[1], allowMissingColumns=True).where("fecha is not null")
        return juntos.groupBy("fecha").agg(*[F.sum(c).alias(c) for c in _ESTADO])

    @staticmethod
    def _diferencias(previsto: DataFrame, antes: DataFrame) -> tuple[dict[date, int], list[date]]:
        """Days to write with their rows, and days to remove: a value a day."""
        viejo = antes.select(F.col("fecha").alias("dia"), *[F.col(c).alias(f"antes_{c}") for c in _ESTADO])
        igual = F.lit(True)
        for c in _ESTADO:
            igual &= F.col(c).eqNullSafe(F.col(f"antes_{c}"))
        filas = sum((F.coalesce(f"filas_{n}", F.lit(0)) for n in HECHOS), F.lit(0)).cast("long").alias("filas")
        distintos = previsto.join(viejo, F.col("fecha") == F.col("dia"), "full").where(~igual).select("fecha", "dia", filas)
        halladas = list(distintos.toLocalIterator())
        return {f.fecha: f.filas for f in halladas if f.fecha}, sorted(f.dia for f in halladas if not f.fecha)

    def _sumas(self, filas: Mapping[date, int]) -> DataFrame:
        """The sums of these days. The rows of each day are known, so they go
        straight to the tasks that sum and write it: one shuffle, no task with
        more than it can hold, a file a task and day. Rows are not summed before
        it, since most keys are a day's only; the keys that are not (a day that
        is too large for one task may have some) are summed on the map side."""
        movs = self._movimientos_de(filas)
        if not filas:
            return consolidar(movs, CLAVES)
        calientes = self._calientes({d: n for d, n in filas.items() if n > FILAS_POR_TAREA})
        if not calientes:
            return self._en_tareas(movs, filas)
        de_moda, resto = separar(movs.withColumn("clave", F.xxhash64(*CLAVES)), "clave", calientes)
        return self._en_tareas(resto.drop("clave"), filas).unionByName(consolidar(de_moda, CLAVES))

    def _movimientos_de(self, dias: Iterable[date]) -> DataFrame:
        rangos = en_tramos(dias)
        ventas = movimientos_venta(self.base.ventas(None, rangos), CLAVES)
        stock = movimientos_stock(self.base.stock(None, rangos), CLAVES)
        return ventas.unionByName(stock)

    def _calientes(self, grandes: Mapping[date, int]) -> list[int]:
        """Hashes of keys that fill half a task, of the days over one task."""
        if not grandes:
            return []
        claves = self._movimientos_de(grandes).select(F.xxhash64(*CLAVES).alias("clave"))
        partes = -(-2 * sum(grandes.values()) // FILAS_POR_TAREA)
        return valores_calientes(claves, "clave", min(partes, MAS_PARTES))

    def _en_tareas(self, movs: DataFrame, filas: Mapping[date, int]) -> DataFrame:
        llenar = -(-sum(filas.values()) // self.spark.sparkContext.defaultParallelism)
        repartos = repartir(filas, FILAS_POR_TAREA, min(llenar, FILAS_POR_TAREA))
        dias = self.spark.createDataFrame([(r.fecha, r.primera, r.cuantas) for r in repartos], "dia date, primera int, cuantas int")
        tarea = F.col("primera") + F.pmod(F.xxhash64(*CLAVES), F.col("cuantas")).cast("int")
        con_tarea = movs.join(F.broadcast(dias), F.col("fecha") == F.col("dia")).select(*CLAVES, *MEDIDAS, tarea.alias("tarea"))
        numero = repartos[-1].primera + repartos[-1].cuantas
        # Tasks are part of the key, so that the sums need no further shuffle.
        return consolidar(con_tarea.repartitionById(numero, "tarea"), ["tarea", *CLAVES]).drop("tarea")
