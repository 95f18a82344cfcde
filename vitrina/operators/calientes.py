"""Joins whose key has a few values with a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values the sketch follows; a value it does not name has less than one in this many rows.
SEGUIDOS = 4096
MAS_FRECUENTES = 64


def valores_calientes(df: DataFrame, clave: str, partes: int) -> list[str]:
    """Values of a text key that hold more than one of ``partes`` equal parts of
    all rows, at most ``MAS_FRECUENTES``. One pass over the key alone with a
    frequent-items sketch of fixed size per task; counts are estimates, which
    only decide how a row is joined."""
    mas = F.expr(f"approx_top_k({clave}, {MAS_FRECUENTES}, {SEGUIDOS})")
    fila = df.where(F.col(clave).isNotNull()).agg(F.count(F.lit(1)).alias("filas"), mas.alias("mas")).first()
    return [v["item"] for v in fila["mas"] or [] if v["count"] * partes > fila["filas"]]


def separar(df: DataFrame, clave: str, valores: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with one of the values, and the others, those without a value among them."""
    caliente = F.coalesce(F.col(clave).isin(list(valores)), F.lit(False))
    return df.where(caliente), df.where(~caliente)
