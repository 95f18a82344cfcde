"""Column expressions shared by the reports. All are JVM built-ins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Rango

# Weekday names, Monday first.
DIAS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")


# --- dates -----------------------------------------------------------------


def lunes(fecha: Column) -> Column:
    return F.trunc(fecha, "week")


def en_rangos(fecha: str, rangos: Iterable[Rango]) -> str:
    """SQL condition: ``fecha`` inside any of the inclusive date ranges."""
    partes = [f"{fecha} between date'{desde}' and date'{hasta}'" for desde, hasta in rangos]
    return " or ".join(partes) or "false"


def corte_semanal(fecha: Column) -> Column:
    """Saturday before the week of ``fecha``."""
    return F.date_sub(lunes(fecha), 2)


def nombre_dia(fecha: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIAS)), F.weekday(fecha) + 1)


# --- labels: null in, null out ------------------------------------------------


def _dos_cifras(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def etiqueta_semana(dia_fin: Column, n_sem: Column) -> Column:
    """``2001-09-09 Sem 36``: sorts as text in time order."""
    return F.concat(F.date_format(dia_fin, "yyyy-MM-dd"), F.lit(" Sem "), _dos_cifras(n_sem))


def etiqueta_lunes(dia: Column, n_sem: Column) -> Column:
    """``01/36 - 09/03``."""
    return F.concat(
        F.date_format(dia, "yy"),
        F.lit("/"),
        _dos_cifras(n_sem),
        F.lit(" - "),
        F.date_format(dia, "MM/dd"),
    )


def subclase(categoria: Column) -> Column:
    return F.substring(categoria, 1, 7)


def sin_prefijo(ciudad: Column) -> Column:
    """City name without its five-character prefix."""
    return F.substring(ciudad, 6, 2_147_483_647)


def texto_pct(valor: Column) -> Column:
    """One decimal, rounded from the exact binary value; null for null."""
    return F.concat(F.call_function("format_number", valor, F.lit("0.0")), F.lit("%"))


# --- prices ------------------------------------------------------------------


def precio_medio(importe: Column, unidades: Column) -> Column:
    """Units-weighted mean price rounded half away from zero, null without
    units. The operands are narrowed so that the quotient keeps 12 decimals."""
    cociente = importe.cast("decimal(28,2)") / F.nullif(unidades, F.lit(0)).cast("decimal(18,0)")
    return F.round(cociente, 0).cast("double")


def precio_o_cero(importe: Column, unidades: Column) -> Column:
    return F.when(unidades == 0, F.lit(0.0)).otherwise(precio_medio(importe, unidades))


def precio_no_cero(importe: Column, unidades: Column) -> Column:
    """Null without sales and also when the rounded mean is zero."""
    return F.nullif(precio_medio(importe, unidades), F.lit(0.0))


# --- ratios ------------------------------------------------------------------


def porcentaje(parte: Column, total: Column, si_cero: float | None = None) -> Column:
    """``parte / total * 100``; ``si_cero`` where the total is zero or missing."""
    return F.when(total != 0, parte / total * 100).otherwise(F.lit(si_cero).cast("double"))


def razon(numerador: Column, denominador: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(denominador == 0, F.lit(0.0)).otherwise(numerador / denominador)


def crecimiento_pct(actual: Column, anterior: Column) -> Column:
    """Growth in percent; without a previous sale it is 100, or 0 if there is
    none now either."""
    return (
        F.when(anterior > 0, (actual - anterior) / anterior * 100)
        .when(actual == 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )
