"""What the reports of one source share: dimensions, groups and results,
written once to the shared folder and measured on the way."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import etiqueta_lunes, etiqueta_semana
from ..operators.articulos import con_color, con_programa, marca_efectiva
from ..operators.calientes import valores_calientes
from ..params import Rango
from ..sources.almacen import LIMITE_DIFUSION, Almacen, Medida, carpeta_compartida
from ..sources.compartidas import TablasCompartidas
from ..sources.tablas import Fuente

T = TypeVar("T")

VIGENCIA = 1800  # seconds a written table is reused

COLUMNAS_ARTICULO = (
    "ean",
    "sku",
    "ref_modelo",
    "subclase",
    "cod_color",
    "talla",
    "descripcion_nueva",
    "marca_calc",
    "tipo_calc",
    "fit_calc",
)
COLUMNAS_COLOR = ("codigo", "color", "color_hexa")


class Contexto:
    """A source plus the tables derived from it.

    ``limite_difusion`` is the measured size in bytes up to which a dimension
    is broadcast. Beyond it the reports first consolidate the facts and then
    join without a hint, with the same result.

    ``compartido`` names the source for other sessions: contexts with one name
    use each other's tables until these expire. Without it a context's tables
    are its own.
    """

    def __init__(
        self,
        fuente: Fuente,
        *,
        limite_difusion: int = LIMITE_DIFUSION,
        vigencia: float = VIGENCIA,
        compartido: str | None = None,
    ):
        self.fuente = fuente
        self.spark = fuente.spark
        self.almacen = Almacen(self.spark, limite_difusion)
        self._vigencia = vigencia
        self._compartidas = None
        if compartido is not None:
            raiz = f"{carpeta_compartida(self.spark)}/vitrina-de-{compartido}"
            self._compartidas = TablasCompartidas(self.spark, self.almacen, raiz, vigencia=vigencia)
            self._compartidas.limpiar()
        self._guardadas: dict[tuple, tuple[float, Medida]] = {}
        self._cerrojos: dict[tuple, threading.Lock] = {}
        self._cerrojo = threading.Lock()

    # --- dimensions ---------------------------------------------------------

    def tabla(self, nombre: str) -> Medida:
        """One of the small rule tables (brands, programmes, colours) as it
        is. Measured, so that the catalogue is enriched without a shuffle on
        their few, unevenly used keys."""
        return self.una_vez((nombre,), lambda: self.fuente.tabla(nombre))

    def articulos(self, cliente: str, color: bool = False) -> Medida:
        """Catalogue rows with brand, programme and fit as this client sees
        them; with ``color`` also the colour table's columns."""
        if color:
            return self.una_vez(
                ("articulos_color", cliente),
                lambda: con_color(self.articulos(cliente).df, self.tabla("cod_color").lado()),
            )
        return self.una_vez(("articulos", cliente), lambda: self._articulos(cliente))

    def _articulos(self, cliente: str) -> DataFrame:
        excepciones, correcciones = self.tabla("marca_subclase").lado(), self.tabla("marca").lado()
        con_marca = marca_efectiva(self.fuente.tabla("cat_sku"), excepciones, correcciones, cliente)
        return con_programa(con_marca, self.tabla("monitoreo").lado()).select(*COLUMNAS_ARTICULO)

    def tiendas(self, cliente: str) -> Medida:
        return self.una_vez(
            ("tiendas", cliente),
            lambda: self.fuente.tabla("tiendas")
            .where(F.col("ini_cliente") == cliente)
            .select(F.col("codigo").alias("num_local"), "local", "ciudad", F.col("tipo").alias("tipo_tienda")),
        )

    def semanas(self) -> Medida:
        """Calendar keyed by Monday, with both week labels."""
        return self.una_vez(
            ("semanas",),
            lambda: self.fuente.tabla("semanas").select(
                F.col("dia_inicio").alias("lunes"),
                "dia_fin",
                "n_sem",
                "ano",
                etiqueta_semana(F.col("dia_fin"), F.col("n_sem")).alias("semanas"),
                etiqueta_lunes(F.col("dia_inicio"), F.col("n_sem")).alias("semanas_lunes"),
            ),
        )

    def sku_madre(self) -> Medida:
        """Retailer catalogue keyed by the fact's ``ean``."""
        return self.una_vez(
            ("sku_madre",),
            lambda: self.fuente.tabla("ecat_fala").select(F.col("upc").alias("ean"), "sku_madre"),
        )

    def dias(self, hecho: str) -> DataFrame:
        """Days and clients of a fact table with their rows. The source's own
        summary, as it is now, where it keeps one; else taken from the facts once."""
        if self.fuente.guarda_dias(hecho):
            return self.fuente.dias(hecho)
        dias = self.una_vez(
            ("dias", hecho), lambda: self.fuente.dias(hecho).select("fecha", "ini_cliente", "filas"), medir=False
        )
        return dias.df

    def articulos_calientes(self, cliente: str, ventas: Sequence[Rango], stock: Sequence[Rango]) -> list[str]:
        """Items with so many rows in these windows that the tasks that join
        them would be the last to end. Only asked for where the item table is
        too large to broadcast."""
        clave = ("calientes", cliente, tuple(ventas), tuple(stock))
        partes = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def hallar() -> DataFrame:
            eans = self.fuente.movimientos(cliente, ventas, stock).select("ean")
            return self.spark.createDataFrame([(v,) for v in valores_calientes(eans, "ean", partes)], "ean string")

        return [f.ean for f in self.una_vez(clave, hallar, medir=False).df.collect()]

    # --- cache ----------------------------------------------------------------

    def una_vez(self, clave: tuple, derivar: Callable[[], DataFrame], *, medir: bool = True) -> Medida:
        """The table ``clave`` names, written on first use and again once its
        time is up. Threads asking for the same table wait for one write."""
        with self._cerrojo:
            cerrojo = self._cerrojos.setdefault(clave, threading.Lock())
        with cerrojo:
            if not self._vigente(clave):
                nombre = "-".join(str(parte) for parte in clave if isinstance(parte, (str, int, date)))
                if self._compartidas is None:
                    tabla, queda = self.almacen.guardar(nombre, derivar(), medir=medir), self._vigencia
                else:
                    ficha = self._compartidas.obtener(clave, derivar, medir=medir)
                    tabla, queda = ficha.medida, ficha.vence - time.time()
                self._guardadas[clave] = (time.monotonic() + queda, tabla)
            return self._guardadas[clave][1]

    def _vigente(self, clave: tuple) -> bool:
        guardada = self._guardadas.get(clave)
        return guardada is not None and time.monotonic() <= guardada[0]

    def resultado(self, reporte: Callable[..., DataFrame], parametros: Hashable, **opciones) -> DataFrame:
        """Rows of a report, computed once and kept while they are valid, for
        the analyses that read them several times."""
        clave = (reporte.__name__, parametros, tuple(sorted(opciones.items())))
        return self.una_vez(clave, lambda: reporte(self, parametros, **opciones), medir=False).df

    def resultados(
        self, *pedidos: tuple[Callable[..., DataFrame], Hashable, dict], hilos: int | None = None
    ) -> list[DataFrame]:
        """Several reports at once, at most ``hilos`` of them: their jobs overlap,
        so one's tail does not leave the cluster idle. Each pedido is (report,
        parameters, options)."""
        return self._a_la_vez([lambda r=r, p=p, o=o: self.resultado(r, p, **o) for r, p, o in pedidos], hilos)

    def preparar(self, cliente: str, *, color: bool = False) -> None:
        """Write the dimensions a report of this client needs, side by side;
        the item tables follow the rule tables they are built from."""
        articulos = ["articulos", *(["articulos_color"] if color else [])]
        claves = [("semanas",), *((n, cliente) for n in ("tiendas", *articulos))]
        if all(map(self._vigente, claves)):
            return
        reglas = ["marca_subclase", "marca", "monitoreo", *(["cod_color"] if color else [])]
        self._a_la_vez(
            [
                *(lambda r=r: self.tabla(r) for r in reglas),
                lambda: self.tiendas(cliente),
                self.semanas,
            ]
        )
        for nombre in articulos:
            self.articulos(cliente, nombre == "articulos_color")

    def cerrar(self) -> None:
        """Delete the tables that were written; frames that read them are void.
        Shared tables stay for others until they expire."""
        self._guardadas.clear()
        self.almacen.borrar()
        if self._compartidas is not None:
            self._compartidas.limpiar()

    def _a_la_vez(self, tareas: Sequence[Callable[[], T]], hilos: int | None = None) -> list[T]:
        """Each task in a scheduler pool of its own: under FAIR scheduling none
        waits for the jobs of another, under FIFO the pools mean nothing."""
        con_sesion = inheritable_thread_target(self.spark)

        def en_su_cola(numero: int, tarea: Callable[[], T]) -> T:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"vitrina-{numero}")
            return tarea()

        with ThreadPoolExecutor(hilos or len(tareas)) as trabajadores:
            futuros = [trabajadores.submit(con_sesion(en_su_cola), n, t) for n, t in enumerate(tareas)]
            return [f.result() for f in futuros]
