"""Numbered versions of small tables in a folder any session can reach."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Carpetas:
    """Tables ``<name>-<number>`` below one root. A version counts once its
    success mark is there; readers take the greatest such number."""

    def __init__(self, spark: SparkSession, raiz: str):
        self.spark = spark
        self.raiz = raiz

    def _ruta(self, ruta: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(ruta)

    def _fs(self, ruta: str):
        return self._ruta(ruta).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def nombres(self) -> list[str]:
        fs = self._fs(self.raiz)
        if not fs.exists(self._ruta(self.raiz)):
            return []
        return [estado.getPath().getName() for estado in fs.listStatus(self._ruta(self.raiz))]

    def existe(self, ruta: str) -> bool:
        return self._fs(ruta).exists(self._ruta(ruta))

    def modificada(self, ruta: str) -> float:
        """Seconds since the epoch when this was last changed, by the storage's clock."""
        return self._fs(ruta).getFileStatus(self._ruta(ruta)).getModificationTime() / 1000

    def versiones(self, nombre: str) -> list[tuple[int, str]]:
        """Every version that was begun, in order."""
        patron = re.compile(rf"{re.escape(nombre)}-(\d+)")
        halladas = [(int(m[1]), f"{self.raiz}/{n}") for n in self.nombres() if (m := patron.fullmatch(n))]
        return sorted(halladas)

    def completa(self, ruta: str) -> bool:
        return self.existe(f"{ruta}/_SUCCESS")

    def ultima(self, nombre: str) -> str | None:
        return next((ruta for _, ruta in reversed(self.versiones(nombre)) if self.completa(ruta)), None)

    def escribir(self, df: DataFrame, nombre: str) -> str:
        """Write the next version; earlier ones go afterwards, but for the last,
        which a reader may have open."""
        antes = self.versiones(nombre)
        ruta = f"{self.raiz}/{nombre}-{antes[-1][0] + 1 if antes else 1:08d}"
        df.write.parquet(ruta)
        for _, vieja in antes[:-1]:
            self.borrar(vieja)
        return ruta

    def escribir_texto(self, nombre: str, texto: str) -> bool:
        """A small file that must not exist yet; False if it does. The storage
        decides between two that try at once."""
        ruta = f"{self.raiz}/{nombre}"
        try:
            salida = self._fs(ruta).create(self._ruta(ruta), False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        salida.write(bytearray(texto.encode()))
        salida.close()
        return True

    def leer_texto(self, nombre: str) -> str:
        ruta = f"{self.raiz}/{nombre}"
        try:
            entrada = self._fs(ruta).open(self._ruta(ruta))
        except Py4JJavaError as error:
            if "FileNotFound" not in str(error.java_exception.getClass().getName()):
                raise
            raise FileNotFoundError(ruta) from None
        try:
            return bytes(entrada.readAllBytes()).decode()
        finally:
            entrada.close()

    def borrar_todas(self, nombre: str) -> None:
        for _, ruta in self.versiones(nombre):
            self.borrar(ruta)

    def borrar(self, ruta: str) -> None:
        self._fs(ruta).delete(self._ruta(ruta), True)
