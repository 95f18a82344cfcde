"""Tables that several sessions share until they expire.

Below one root in the shared folder each key has numbered versions of its table,
a record of the version that counts, and while one is being written a lease:

* ``<key>-<number>`` is the table. It counts only once its record names it, so a
  table that was left half-written is never read.
* ``<key>.ficha-<number>`` is the record, written last: schema, measure, expiry.
* ``<key>.reserva`` is the lease. The storage creates it for one session only;
  others wait for the record, or take over once the lease has run out.

Expired versions are kept as long again, since a query may still read them, and
then deleted with their records; so are versions whose writer was lost.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .almacen import Almacen, Medida
from .carpetas import Carpetas

ESPERA = 0.2  # seconds between looks at a table that another session writes


@dataclass(frozen=True)
class Ficha:
    ruta: str
    vence: float
    medida: Medida


class TablasCompartidas:
    """``vigencia``: seconds a table is reused. ``plazo``: seconds a writer has
    before another session may take over."""

    def __init__(self, spark: SparkSession, almacen: Almacen, raiz: str, *, vigencia: float, plazo: float = 600):
        self.spark = spark
        self.almacen = almacen
        self.carpetas = Carpetas(spark, raiz)
        self.vigencia = vigencia
        self.plazo = plazo
        self.propio = uuid.uuid4().hex

    def obtener(self, clave: tuple, derivar: Callable[[], DataFrame], *, medir: bool = True) -> Ficha:
        """The valid table of this key, of whichever session; else it is written."""
        nombre = self._nombre(clave)
        while True:
            if ficha := self._vigente(nombre):
                return ficha
            if self._reservar(nombre):
                try:
                    # It may have been written between the look and the lease.
                    return self._vigente(nombre) or self._escribir(nombre, derivar(), medir)
                finally:
                    self._soltar(nombre)
            time.sleep(ESPERA)

    def limpiar(self) -> list[str]:
        """Delete what nobody may read any more; the names of the tables that went."""
        ahora, quitadas = time.time(), []
        nombres = self.carpetas.nombres()
        for nombre in nombres:
            if not (m := re.fullmatch(r"(.+)-(\d+)", nombre)) or ".ficha" in nombre:
                continue
            registro = f"{m[1]}.ficha-{m[2]}"
            ficha = self._leer(registro) if registro in nombres else None
            if ficha is not None:
                caducada = ficha.vence + self.vigencia < ahora
            else:
                caducada = self.carpetas.modificada(f"{self.carpetas.raiz}/{nombre}") + self.plazo < ahora
            if caducada:
                self.carpetas.borrar(f"{self.carpetas.raiz}/{registro}")
                self.carpetas.borrar(f"{self.carpetas.raiz}/{nombre}")
                quitadas.append(nombre)
        return quitadas

    # --- records ----------------------------------------------------------------------

    @staticmethod
    def _nombre(clave: tuple) -> str:
        legible = re.sub(r"[^\w]+", "_", str(clave[0]))[:40]
        return f"{legible}-{hashlib.sha256(repr(clave).encode()).hexdigest()[:24]}"

    def _vigente(self, nombre: str) -> Ficha | None:
        for _, ruta in reversed(self.carpetas.versiones(f"{nombre}.ficha")):
            ficha = self._leer(ruta.rsplit("/", 1)[1])
            if ficha is not None:
                return ficha if ficha.vence > time.time() and self.carpetas.completa(ficha.ruta) else None
        return None

    def _leer(self, registro: str) -> Ficha | None:
        try:
            datos = json.loads(self.carpetas.leer_texto(registro))
        except ValueError:  # cut off while it was written
            return None
        esquema = T.StructType.fromJson(datos["esquema"])
        df = self.spark.read.schema(esquema).parquet(datos["ruta"])
        return Ficha(datos["ruta"], datos["vence"], Medida(df, datos["filas"], datos["bytes"], self.almacen.limite))

    def _escribir(self, nombre: str, df: DataFrame, medir: bool) -> Ficha:
        anteriores = self.carpetas.versiones(nombre)
        numero = f"{anteriores[-1][0] + 1 if anteriores else 1:08d}"
        ruta = f"{self.carpetas.raiz}/{nombre}-{numero}"
        medida = self.almacen.escribir(ruta, df, medir=medir)
        vence = time.time() + self.vigencia
        datos = {"ruta": ruta, "vence": vence, "filas": medida.filas, "bytes": medida.bytes_, "esquema": df.schema.jsonValue()}
        self.carpetas.escribir_texto(f"{nombre}.ficha-{numero}", json.dumps(datos))
        return Ficha(ruta, vence, medida)

    # --- leases -----------------------------------------------------------------------

    def _reservar(self, nombre: str) -> bool:
        reserva = f"{nombre}.reserva"
        texto = json.dumps({"de": self.propio, "hasta": time.time() + self.plazo})
        if self.carpetas.escribir_texto(reserva, texto):
            return True
        try:
            otra = json.loads(self.carpetas.leer_texto(reserva))
        except (ValueError, FileNotFoundError):
            return False
        if otra["hasta"] < time.time():
            # Its session is lost. Of those that find this, the one that creates the next lease writes.
            self.carpetas.borrar(f"{self.carpetas.raiz}/{reserva}")
        return False

    def _soltar(self, nombre: str) -> None:
        self.carpetas.borrar(f"{self.carpetas.raiz}/{nombre}.reserva")
