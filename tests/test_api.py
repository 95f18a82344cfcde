import datetime as dt

import pytest
from apoyo import filas

from vitrina.api import LISTAS, REPORTES, consultar
from vitrina.params import Ventana
from vitrina.plans import reportes
from vitrina.plans.contexto import Contexto
from vitrina.sources import FuenteEstrella

PARAMETROS = {
    "ini_cliente": "FL",
    "fecha_inicio": dt.date(2001, 8, 5),
    "fecha_fin": dt.date(2001, 9, 9),
    "fecha_inicio_stock": dt.date(2001, 9, 3),
    "stock_threshold": 30,
    "semanas_stock": 8,
    "semanas_venta": 8,
    "as_of": dt.date(2001, 9, 10),
}


@pytest.fixture(scope="module")
def ctx(spark, datos):
    return Contexto(FuenteEstrella(spark, datos))


@pytest.mark.parametrize("nombre", [*REPORTES, *LISTAS])
def test_por_nombre(ctx, nombre):
    assert consultar(ctx, nombre, PARAMETROS).count() > 0


def test_parametros_y_guardado(ctx):
    p = Ventana(dt.date(2001, 8, 5), dt.date(2001, 9, 9), "FL", dt.date(2001, 9, 3), 30)
    esperado = filas(reportes.ventas_por_talla(ctx, p, solo_validas=True))
    guardado = consultar(ctx, "ventas_por_talla", PARAMETROS, guardar=True, solo_validas=True)
    assert filas(guardado) == esperado
    assert consultar(ctx, "ventas_por_talla", PARAMETROS, guardar=True, solo_validas=True) is guardado


def test_lista_guardada(ctx):
    semanas = consultar(ctx, "semanas_disponibles", guardar=True)
    directas = consultar(ctx, "semanas_disponibles")
    assert semanas.collect() == directas.collect()
    assert filas(consultar(ctx, "clientes", guardar=True)) == [("FL",), ("RP",)]


def test_nombre_desconocido(ctx):
    with pytest.raises(KeyError):
        consultar(ctx, "ventas_por_arte")
