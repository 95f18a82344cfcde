"""Movements: sales and stock snapshots as one stream of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expresiones import lunes

GRANO = ("num_local", "ean", "fecha")
MEDIDAS = ("cant_venta", "cant_stock", "importe", "n_venta", "n_stock")


def movimientos_venta(ventas: DataFrame, claves: Sequence[str] = GRANO) -> DataFrame:
    return ventas.selectExpr(
        *claves,
        "cant as cant_venta",
        "0 as cant_stock",
        "cant * pvp_unit as importe",
        "1 as n_venta",
        "0 as n_stock",
    )


def movimientos_stock(stock: DataFrame, claves: Sequence[str] = GRANO) -> DataFrame:
    return stock.selectExpr(
        *claves,
        "0 as cant_venta",
        "cant as cant_stock",
        "cast(0 as decimal(23,2)) as importe",
        "0 as n_venta",
        "1 as n_stock",
    )


def unir_movimientos(ventas: DataFrame, stock: DataFrame) -> DataFrame:
    """``UNION ALL`` of both facts, each zero on the other's measures."""
    return movimientos_venta(ventas).unionByName(movimientos_stock(stock))


def por_semana(movimientos: DataFrame) -> DataFrame:
    """Move every row to the Monday of its week."""
    return movimientos.withColumn("fecha", lunes(F.col("fecha")))


def consolidar(
    movimientos: DataFrame, claves: Sequence[str] = GRANO, medidas: Sequence[str] = MEDIDAS
) -> DataFrame:
    """One row per store, item and date. All measures are sums, so this is
    exact before any join, repeated dimension keys included; it combines on
    the map side and leaves at most stores x dates rows of one item, however
    often the item occurs in the facts."""
    return movimientos.groupBy(*claves).agg(*(F.sum(m).alias(m) for m in medidas))
