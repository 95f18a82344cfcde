"""User selections on a finished report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Seleccion = Mapping[str, "str | Sequence[str]"]

TODOS = "Todos"
# Filter columns offered to the user and whether their options
# are listed in descending order.
COLUMNAS_FILTRO = {
    "tipo_programa": True,
    "marca": False,
    "fit_estilo": True,
    "semanas": True,
}


def predicado(selecciones: Seleccion) -> Column:
    """``=`` for a single value, ``IN`` for a list; "Todos" selects all."""
    condicion = F.lit(True)
    for columna, valor in selecciones.items():
        if isinstance(valor, str) or not isinstance(valor, Sequence):
            if valor != TODOS:
                condicion = condicion & (F.col(columna) == valor)
        else:
            condicion = condicion & F.col(columna).isin(list(valor))
    return condicion


def filtros_dinamicos(df: DataFrame, selecciones: Seleccion) -> DataFrame:
    return df.where(predicado(selecciones))


def una_tienda(df: DataFrame, codigo: str) -> DataFrame:
    return df.where(F.col("c_l") == codigo)


def opciones_filtro(df: DataFrame, columna: str, desc: bool = False) -> DataFrame:
    """Distinct values of a column as text, in display order."""
    opcion = F.col("opcion")
    return (
        df.select(F.col(columna).cast("string").alias("opcion"))
        .dropna()
        .distinct()
        .orderBy(opcion.desc() if desc else opcion.asc())
    )


def opciones_filtros(df: DataFrame, columnas: Mapping[str, bool] = COLUMNAS_FILTRO) -> DataFrame:
    """The options of several filters from one pass over the report."""
    pares = [
        F.struct(
            F.lit(nombre).alias("filtro"),
            F.col(nombre).cast("string").alias("opcion"),
            F.lit(desc).alias("descendente"),
        )
        for nombre, desc in columnas.items()
    ]
    return df.select(F.inline(F.array(*pares))).dropna(subset=["opcion"]).distinct()


def vista_previa(df: DataFrame, orden: Sequence[Column | str], n: int = 10) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-n, not a full sort)."""
    return df.orderBy(*orden).limit(n)
