"""Size curve order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The size order of the curve, first to last.
ORDEN_TALLAS: tuple[str, ...] = (
    "U",
    *(f"{n}M" for n in range(21)),
    *(str(n) for n in range(1, 51)),
    "XXS", "SX", "S", "M", "L", "XL", "XXL",
)


def posicion_talla(talla: Column, orden: Sequence[str] = ORDEN_TALLAS) -> Column:
    """1-based place in the size order, null for sizes that are not listed."""
    lugar = F.array_position(F.array(*map(F.lit, orden)), talla)
    return F.nullif(lugar, F.lit(0)).cast("int")
