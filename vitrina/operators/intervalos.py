"""Overlap of two sets of date ranges as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAS_POR_CASILLA = 56


def _casilla(dia: Column, ancho: int) -> Column:
    return F.floor(F.unix_date(dia) / F.lit(ancho)).cast("int")


def unir_solapados(
    izquierda: DataFrame,
    derecha: DataFrame,
    *,
    desde: tuple[str, str],
    hasta: tuple[str, str],
    ancho: int = DIAS_POR_CASILLA,
) -> DataFrame:
    """Pairs of rows whose inclusive date ranges overlap. ``desde`` and ``hasta``
    name the bounds on the left and on the right; column names must differ.

    Time is cut into boxes of ``ancho`` days. A row goes to every box its range
    touches and meets only the rows of the same box, so the join has a key to
    shuffle or broadcast by, and no row is compared with all others. A pair that
    shares several boxes is taken in the first one. Rows whose range is empty or
    unknown overlap nothing.
    """
    lados = []
    for df, ini, fin, nombre in (
        (izquierda, desde[0], hasta[0], "__primera_i"),
        (derecha, desde[1], hasta[1], "__primera_d"),
    ):
        primera, ultima = _casilla(F.col(ini), ancho), _casilla(F.col(fin), ancho)
        validos = df.where(F.col(ini) <= F.col(fin))
        lados.append(
            validos.select("*", primera.alias(nombre), F.explode(F.sequence(primera, ultima)).alias("__casilla"))
        )
    solapan = (F.col(desde[0]) <= F.col(hasta[1])) & (F.col(desde[1]) <= F.col(hasta[0]))
    en_la_primera = F.col("__casilla") == F.greatest("__primera_i", "__primera_d")
    return lados[0].join(lados[1], "__casilla").where(solapan & en_la_primera).drop("__casilla", "__primera_i", "__primera_d")
