"""Report parameters: dates are resolved to literals on the driver, so that
scans prune statically instead of joining with a parameter table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from datetime import date, timedelta
from typing import Any

CLIENTE_DEFECTO = "FL"
UMBRAL_DEFECTO = 800
SEMANAS_DEFECTO = 4
SEMANAS_ULTIMAS = 8
CORTE_COLOR = 1.5
CORTE_TALLA = 0.5

Rango = tuple[date, date]


def lunes_de(dia: date) -> date:
    return dia - timedelta(days=dia.weekday())


def sabado_de_corte(dia: date) -> date:
    """The last Saturday before the week of ``dia``."""
    return lunes_de(dia) - timedelta(days=2)


def lunes_de_etiqueta(semana: str) -> date:
    """Monday of a week label such as ``2001-09-09 Sem 36``, which begins with its Sunday."""
    return date.fromisoformat(semana[:10]) - timedelta(days=6)


def en_semanas(rango: Rango, lunes: Sequence[date]) -> list[Rango]:
    """The part of each of these weeks that lies in the range."""
    semanas = ((max(rango[0], d), min(rango[1], d + timedelta(days=6))) for d in sorted(set(lunes)))
    return [(desde, hasta) for desde, hasta in semanas if desde <= hasta]


def un_ano_antes(dia: date) -> date:
    """Same calendar day one year before; 29 February falls back to the 28th."""
    try:
        return dia.replace(year=dia.year - 1)
    except ValueError:
        return dia.replace(year=dia.year - 1, day=28)


class _DesdeDict:
    @classmethod
    def desde_dict(cls, valores: Mapping[str, Any]):
        """Build from named query parameters. Names of other reports are passed
        over so one mapping can serve several; a name no report knows is an error."""
        conocidos = {n for c in _DesdeDict.__subclasses__() for n in (*c.ALIAS, *(f.name for f in fields(c)))}
        if ajenos := set(valores) - conocidos:
            raise ValueError(f"unknown parameters: {', '.join(sorted(ajenos))}")
        nombres = {f.name for f in fields(cls)}
        propios = {cls.ALIAS.get(k, k): v for k, v in valores.items()}
        return cls(**{k: v for k, v in propios.items() if k in nombres})


@dataclass(frozen=True)
class Ventana(_DesdeDict):
    """Sales window plus stock window. ``fecha_fin`` is also the snapshot on
    which brand groups are measured against ``umbral``."""

    fecha_inicio: date
    fecha_fin: date
    cliente: str = CLIENTE_DEFECTO
    fecha_inicio_stock: date | None = None
    umbral: int = UMBRAL_DEFECTO

    ALIAS = {
        "ini_cliente": "cliente",
        "stock_threshold": "umbral",
        "fecha_inicio_venta": "fecha_inicio",
        "fecha_fin_venta": "fecha_fin",
    }

    @property
    def rango_ventas(self) -> Rango:
        return self.fecha_inicio, self.fecha_fin

    @property
    def rango_stock(self) -> Rango:
        return self.fecha_inicio_stock or self.fecha_inicio, self.fecha_fin

    def ultima_semana_de_stock(self) -> "Ventana":
        """Colour and size reports only look at the last seven days of stock."""
        return Ventana(
            self.fecha_inicio,
            self.fecha_fin,
            self.cliente,
            self.fecha_fin - timedelta(days=6),
            self.umbral,
        )


@dataclass(frozen=True)
class VentanaAnual(_DesdeDict):
    """Last ``n`` weeks up to the cut-off Saturday and the same span one
    calendar year before."""

    cliente: str = CLIENTE_DEFECTO
    semanas_stock: int = SEMANAS_DEFECTO
    semanas_venta: int = SEMANAS_DEFECTO
    umbral: int = UMBRAL_DEFECTO
    as_of: date = field(default_factory=date.today)

    ALIAS = {"ini_cliente": "cliente", "stock_threshold": "umbral"}

    def __post_init__(self):
        if min(self.semanas_stock, self.semanas_venta) < 1:
            raise ValueError("at least one week is needed")

    @property
    def corte(self) -> date:
        return sabado_de_corte(self.as_of)

    def rangos(self, semanas: int) -> list[Rango]:
        atras = timedelta(weeks=semanas)
        previo = un_ano_antes(self.corte)
        return [(self.corte - atras, self.corte), (previo - atras, previo)]


@dataclass(frozen=True)
class VentanaReciente(_DesdeDict):
    """The last eight weeks up to this week's Monday."""

    cliente: str = CLIENTE_DEFECTO
    umbral: int = UMBRAL_DEFECTO
    as_of: date = field(default_factory=date.today)

    ALIAS = {"ini_cliente": "cliente", "stock_threshold": "umbral"}

    @property
    def lunes(self) -> date:
        return lunes_de(self.as_of)

    @property
    def rango(self) -> Rango:
        return self.lunes - timedelta(weeks=SEMANAS_ULTIMAS), self.lunes
