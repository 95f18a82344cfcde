"""Tables shared by sessions: reuse, leases, half-written and expired versions."""

import datetime as dt
import json
import threading
import time
from pathlib import Path

import pytest
from apoyo import FuenteMemoria, filas

from vitrina.params import Ventana
from vitrina.plans import reportes
from vitrina.plans.contexto import Contexto
from vitrina.sources.almacen import Almacen
from vitrina.sources.compartidas import TablasCompartidas

CLAVE = ("marca", "FL", dt.date(2001, 9, 9), 7)


@pytest.fixture()
def abrir(spark, tmp_path):
    def nueva(**opciones):
        return TablasCompartidas(spark, Almacen(spark), str(tmp_path / "compartidas"), **{"vigencia": 60, **opciones})

    return nueva


@pytest.fixture()
def derivar(spark):
    def hacer():
        hacer.veces += 1
        return spark.createDataFrame([("a", hacer.veces), ("bb", 2)], "t string, n int")

    hacer.veces = 0
    return hacer


def test_otra_sesion_la_reutiliza(abrir, derivar):
    una, otra = abrir(), abrir()
    primera, segunda = una.obtener(CLAVE, derivar), otra.obtener(CLAVE, derivar)
    assert derivar.veces == 1 and primera.ruta == segunda.ruta
    assert segunda.medida.df.schema == primera.medida.df.schema
    assert (segunda.medida.filas, segunda.medida.bytes_) == (2, primera.medida.bytes_)
    assert filas(segunda.medida.df) == [(1.0, "a"), (2.0, "bb")]
    assert otra.obtener((*CLAVE, 1), derivar).ruta != primera.ruta
    assert not [n for n in una.carpetas.nombres() if n.endswith(".reserva")]


def test_vence_y_se_borra(abrir, derivar):
    corta = abrir(vigencia=0.8)
    primera = corta.obtener(CLAVE, derivar)
    assert corta.limpiar() == []
    time.sleep(0.9)
    segunda = corta.obtener(CLAVE, derivar)
    assert derivar.veces == 2 and segunda.ruta != primera.ruta
    assert Path(primera.ruta).exists()  # a query may still read it
    time.sleep(0.8)
    assert corta.limpiar() == [Path(primera.ruta).name] and not Path(primera.ruta).exists()
    assert corta._leer(f"{corta._nombre(CLAVE)}.ficha-00000002").ruta == segunda.ruta


def test_a_medias_no_se_lee(abrir, derivar, monkeypatch):
    """The writer is lost after the table and before its record, or in the middle of it."""
    una = abrir(plazo=0.3)
    monkeypatch.setattr(una.carpetas, "escribir_texto", lambda nombre, texto: (_ for _ in ()).throw(RuntimeError("lost")) if "ficha" in nombre else True)
    with pytest.raises(RuntimeError):
        una.obtener(CLAVE, derivar)
    otra = abrir(plazo=0.3)
    nombre = otra._nombre(CLAVE)
    otra.carpetas.escribir_texto(f"{nombre}.ficha-00000001", '{"ruta": "x", "ven')
    ficha = otra.obtener(CLAVE, derivar)
    assert derivar.veces == 2 and ficha.ruta.endswith("-00000002")
    time.sleep(0.4)
    assert otra.limpiar() == [f"{nombre}-00000001"]
    assert filas(ficha.medida.df) == filas(otra.obtener(CLAVE, derivar).medida.df)


def test_reserva_de_una_sesion_perdida(abrir, derivar):
    perdida, viva = abrir(plazo=0.5), abrir()
    assert perdida._reservar(perdida._nombre(CLAVE))
    antes = time.monotonic()
    viva.obtener(CLAVE, derivar)
    assert time.monotonic() - antes >= 0.4 and derivar.veces == 1


def test_se_espera_a_quien_escribe(abrir, derivar):
    lenta, otra, halladas = abrir(), abrir(), []

    def despacio():
        time.sleep(0.6)
        return derivar()

    hilos = [threading.Thread(target=lambda t=t: halladas.append(t.obtener(CLAVE, despacio).ruta)) for t in (lenta, otra)]
    for hilo in hilos:
        hilo.start()
    for hilo in hilos:
        hilo.join()
    assert derivar.veces == 1 and len(set(halladas)) == 1


def test_dos_contextos(spark):
    dia = dt.date(2001, 9, 3)
    fuente = FuenteMemoria(
        spark,
        dwh_ventas=[("FL", "1", "e", dia, 2, None)],
        dwh_stock=[("FL", "1", "e", dia + dt.timedelta(6), 5)],
        cat_sku=[("e", "S", "R", "B", "J000001", "001", "30", "d")],
        monitoreo=[("R", "B", "basico", "F")],
        tiendas=[("FL", 1, "L", "000- C", "TIENDA", "A", "1")],
        semanas=[(dia, dia + dt.timedelta(6), 36, 2001)],
    )
    p = Ventana(dia, dia + dt.timedelta(6), umbral=1)
    nombre = f"prueba-{time.time_ns()}"
    uno, otro, propio = Contexto(fuente, compartido=nombre), Contexto(fuente, compartido=nombre), Contexto(fuente)
    tablas = [c.resultado(reportes.ventas_por_tienda, p) for c in (uno, otro, propio)]
    assert tablas[0].inputFiles() == tablas[1].inputFiles() != tablas[2].inputFiles()
    assert filas(tablas[0]) == filas(tablas[2]) != []
    uno.cerrar()
    assert filas(tablas[1]) == filas(tablas[2])
    fichas = [n for n in otro._compartidas.carpetas.nombres() if ".ficha" in n]
    assert all(json.loads(otro._compartidas.carpetas.leer_texto(n))["vence"] > time.time() for n in fichas)
