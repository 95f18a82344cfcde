"""Reports by name with named parameters, the way they are called today.

    ctx = Contexto(FuenteTablas.parquet(spark, "/dwh"))
    consultar(ctx, "ventas_por_tienda", {
        "ini_cliente": "FL", "fecha_inicio": date(2026, 2, 1),
        "fecha_fin": date(2026, 3, 8), "stock_threshold": 800,
    })
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .params import Ventana, VentanaAnual, VentanaReciente
from .plans import catalogos, reportes
from .plans.contexto import Contexto

REPORTES: dict[str, tuple[Callable[..., DataFrame], type]] = {
    "ventas_por_tienda": (reportes.ventas_por_tienda, Ventana),
    "ventas_por_color": (reportes.ventas_por_color, Ventana),
    "ventas_por_talla": (reportes.ventas_por_talla, Ventana),
    "ventas_stock_detalle": (reportes.ventas_stock_detalle, Ventana),
    "ventas_sem_ano": (reportes.ventas_sem_ano, VentanaAnual),
    "ventas_stock_8sem": (reportes.ventas_stock_8sem, VentanaReciente),
}
# Lists with the column that orders them, if any.
LISTAS: dict[str, tuple[Callable[[Contexto], DataFrame], str | None]] = {
    "semanas_disponibles": (catalogos.semanas_disponibles, "fin_semana"),
    "clientes": (catalogos.clientes, None),
    "tiendas": (lambda ctx: catalogos.tiendas(ctx.fuente), None),
    "fechas_corte": (lambda ctx: catalogos.fechas_corte_de(ctx.spark), None),
}


def consultar(
    ctx: Contexto,
    nombre: str,
    parametros: Mapping[str, Any] | None = None,
    *,
    guardar: bool = False,
    **opciones: Any,
) -> DataFrame:
    """Rows of a report or list. ``guardar`` keeps the result for later calls
    with the same parameters; ``solo_validas=True`` leaves out groups below the
    threshold where the report marks them."""
    if nombre in LISTAS:
        lista, orden = LISTAS[nombre]
        if not guardar:
            return lista(ctx)
        guardada = ctx.una_vez(("lista", nombre), lambda: lista(ctx), medir=False).df
        return guardada.orderBy(F.col(orden).desc()) if orden else guardada
    reporte, tipo = REPORTES[nombre]
    p = tipo.desde_dict(parametros or {})
    return ctx.resultado(reporte, p, **opciones) if guardar else reporte(ctx, p, **opciones)
