"""Sources, the shared store, sinks, parameters."""

import datetime as dt
import re
import time
from pathlib import Path

import pytest
from apoyo import FuenteMemoria, filas

import __spark_entry__ as contrato
from vitrina.params import Ventana, VentanaAnual, VentanaReciente, un_ano_antes
from vitrina.plans import reportes
from vitrina.plans.contexto import Contexto
from vitrina.schemas import ESQUEMAS, HECHOS
from vitrina.sinks import exportar, registrar_tiempos
from vitrina.sources import Almacen, FuenteEstrella, FuenteTablas
from vitrina.sources import almacen as modulo_almacen
from vitrina.sources.tablas import escribir_hechos, opciones_jdbc

P = Ventana(dt.date(2001, 8, 5), dt.date(2001, 9, 9), umbral=100)


@pytest.fixture(scope="module")
def estrella(spark, datos):
    return FuenteEstrella(spark, datos)


@pytest.fixture(scope="module")
def carpeta(estrella, tmp_path_factory):
    """The ten tables as stored files, facts partitioned by date."""
    raiz = tmp_path_factory.mktemp("tablas")
    for nombre in ESQUEMAS:
        df = estrella.tabla(nombre)
        if nombre in HECHOS:
            corto = df.where("fecha between date'2001-08-01' and date'2001-09-15'")
            escribir_hechos(corto, f"{raiz}/{nombre}")
        else:
            df.write.parquet(f"{raiz}/{nombre}")
    return str(raiz)


def test_esquemas_de_la_estrella(estrella):
    for nombre, esquema in ESQUEMAS.items():
        tabla = estrella.tabla(nombre).schema
        assert [(c.name, c.dataType) for c in tabla] == [(c.name, c.dataType) for c in esquema], nombre


def test_parquet_particionado(spark, carpeta, estrella):
    fuente = FuenteTablas.parquet(spark, carpeta)
    df = reportes.ventas_por_tienda(Contexto(fuente), P)
    assert filas(df) == filas(reportes.ventas_por_tienda(Contexto(estrella), P))
    stock = fuente.stock("FL", [(P.fecha_fin, P.fecha_fin)]).select("ean", "cant")
    texto = stock._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*fecha#\d+ (=|>=) 2001-09-09", texto)
    assert "PushedFilters: [IsNotNull(ini_cliente), EqualTo(ini_cliente,FL)]" in texto
    assert "ReadSchema: struct<ini_cliente:string,ean:string,cant:int>" in texto


def test_catalogo(spark, carpeta, estrella):
    spark.sql("create database if not exists dbo")
    parquet = FuenteTablas.parquet(spark, carpeta)
    for nombre in ESQUEMAS:
        parquet.tabla(nombre).write.mode("overwrite").saveAsTable(f"dbo.{nombre}")
    fuente = FuenteTablas.catalogo(spark)
    df = reportes.ventas_por_color(Contexto(fuente), P.ultima_semana_de_stock())
    assert filas(df) == filas(reportes.ventas_por_color(Contexto(estrella), P.ultima_semana_de_stock()))


def test_opciones_jdbc():
    fechas = (dt.date(2020, 1, 1), dt.date(2024, 1, 1))
    o = opciones_jdbc("dwh_stock", "jdbc:postgresql://h/db", fechas, 32, "dbo", {"user": "u"})
    assert o["dbtable"] == "dbo.dwh_stock" and o["user"] == "u"
    assert (o["partitionColumn"], o["lowerBound"], o["numPartitions"]) == ("fecha", "2020-01-01", "32")
    assert "partitionColumn" not in opciones_jdbc("marca", "jdbc:x", fechas, 32, "dbo")


def test_poda_en_la_estrella(estrella):
    ventas = estrella.ventas("FL", [P.rango_ventas]).select("ean", "cant")
    texto = ventas._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,2001-08-05T00:00)" in texto
    assert "l_extendedprice" not in texto


@pytest.mark.parametrize("metodo", ["ventas", "stock"])
def test_la_poda_no_pierde_filas(estrella, metodo):
    rangos = [(dt.date(2001, 8, 8), dt.date(2001, 8, 21)), (dt.date(2000, 3, 1), dt.date(2000, 3, 5))]
    podada = getattr(estrella, metodo)("RP", rangos)
    entera = estrella.tabla(f"dwh_{metodo}").where(
        "ini_cliente = 'RP' and (fecha between '2001-08-08' and '2001-08-21'"
        " or fecha between '2000-03-01' and '2000-03-05')"
    )
    assert filas(podada) == filas(entera) != []


# --- store ---------------------------------------------------------------------------------


def test_carpeta_compartida(spark):
    configurada = spark.conf.get("spark.checkpoint.dir")
    assert modulo_almacen.carpeta_compartida(spark) == configurada
    medida = Almacen(spark).guardar("x", spark.range(10).selectExpr("cast(id as string) as t", "id"))
    assert medida.filas == 10 and medida.difundible
    assert medida.bytes_ == {"t": 10 * (16 + 1), "id": 10 * 16}
    assert all(configurada in f for f in medida.df.inputFiles())
    assert not Almacen(spark, limite=5).guardar("y", spark.range(10)).difundible
    justa = Almacen(spark, limite=200).guardar("z", spark.range(10).selectExpr("id", "id as b"))
    assert not justa.difundible and justa.de("id").difundible and justa.de("id").df.columns == ["id"]


class _Conf(dict):
    def get(self, clave, defecto=None):
        return super().get(clave, defecto)


class _Sesion:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_sin_carpeta():
    """Without the setting tables go below the warehouse, whatever the master."""
    for master in ("yarn", "local[2]"):
        sesion = _Sesion(spark_master=master, spark_sql_warehouse_dir="file:/almacen/")
        assert modulo_almacen.carpeta_compartida(sesion) == "file:/almacen/_vitrina"


def test_cerrar_borra_solo_lo_propio(spark, estrella):
    uno, otro = Contexto(estrella), Contexto(estrella)
    propio, ajeno = (c.tiendas("FL").df.inputFiles()[0].removeprefix("file:").replace("///", "/") for c in (uno, otro))
    uno.cerrar()
    assert not Path(propio).exists() and Path(ajeno).exists()
    assert uno.tiendas("FL").df.count() == otro.tiendas("FL").df.count() > 0


def test_tabla_vacia_es_difundible(spark):
    medida = Almacen(spark).guardar("vacia", spark.range(0))
    assert (medida.filas, medida.bytes_, medida.difundible) == (0, {"id": 0}, True)


def test_vigencia(spark):
    fuente = FuenteMemoria(spark, marca=[("B", "N")])
    ctx = Contexto(fuente, vigencia=0.5)
    veces = []

    def derivar():
        veces.append(1)
        return fuente.tabla("marca")

    ctx.una_vez(("marca",), derivar)
    ctx.una_vez(("marca",), derivar)
    assert len(veces) == 1
    time.sleep(0.6)
    ctx.una_vez(("marca",), derivar)
    assert len(veces) == 2


def test_resultados_a_la_vez(estrella):
    ctx = Contexto(estrella)
    color = P.ultima_semana_de_stock()
    validas = {"solo_validas": True}
    juntos = ctx.resultados(
        (reportes.ventas_por_tienda, P, validas),
        (reportes.ventas_por_color, color, validas),
        (reportes.ventas_por_talla, color, validas),
    )
    sueltos = [
        reportes.ventas_por_tienda(ctx, P, solo_validas=True),
        reportes.ventas_por_color(ctx, color, solo_validas=True),
        reportes.ventas_por_talla(ctx, color, solo_validas=True),
    ]
    for junto, suelto in zip(juntos, sueltos):
        assert filas(junto) == filas(suelto)
    assert ctx.resultado(reportes.ventas_por_tienda, P, solo_validas=True) is juntos[0]


# --- sinks -----------------------------------------------------------------------------------


@pytest.mark.parametrize("formato", ["parquet", "csv"])
def test_exportar(spark, estrella, tmp_path, formato):
    detalle = reportes.ventas_stock_detalle(Contexto(estrella), P, solo_validas=True)
    leido = exportar(detalle, str(tmp_path / formato), formato, ["fecha"])
    assert leido.columns == detalle.columns
    assert filas(leido) == filas(detalle)
    assert (tmp_path / formato / "fecha=2001-09-03").exists()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        exportar(detalle, str(tmp_path / formato), formato)


def test_bitacora(spark, tmp_path):
    ruta = str(tmp_path / "tiempos")
    for n in (1, 2):
        registrar_tiempos(spark, [(dt.datetime(2024, 1, n), "q", "0.1", 1.5 * n)], ruta)
    assert sorted(f.segundos for f in spark.read.parquet(ruta).collect()) == [1.5, 3.0]


# --- parameters --------------------------------------------------------------------------------


def test_fechas():
    assert un_ano_antes(dt.date(2024, 2, 29)) == dt.date(2023, 2, 28)
    p = VentanaAnual(as_of=dt.date(2001, 9, 10))
    assert p.corte == dt.date(2001, 9, 8)
    assert p.rangos(4) == [
        (dt.date(2001, 8, 11), dt.date(2001, 9, 8)),
        (dt.date(2000, 8, 11), dt.date(2000, 9, 8)),
    ]
    assert VentanaReciente(as_of=dt.date(2001, 9, 12)).rango == (dt.date(2001, 7, 16), dt.date(2001, 9, 10))
    with pytest.raises(ValueError):
        VentanaAnual(semanas_venta=0)


def test_parametros_por_nombre():
    valores = {
        "fecha_inicio_venta": dt.date(2026, 2, 1),
        "fecha_fin_venta": dt.date(2026, 3, 8),
        "fecha_inicio_stock": dt.date(2026, 2, 1),
        "ini_cliente": "RP",
        "stock_threshold": 500,
        "semanas_stock": 8,
    }
    with pytest.raises(ValueError, match="stock_treshold"):
        Ventana.desde_dict({**valores, "stock_treshold": 500})
    p = Ventana.desde_dict(valores)
    assert (p.cliente, p.umbral, p.rango_ventas) == ("RP", 500, (dt.date(2026, 2, 1), dt.date(2026, 3, 8)))
    assert VentanaAnual.desde_dict(valores).semanas_stock == 8
    assert p.ultima_semana_de_stock().rango_stock == (dt.date(2026, 3, 2), dt.date(2026, 3, 8))


def test_contexto_compartido(spark, datos):
    assert contrato._contexto(spark, datos)[0] is contrato._contexto(spark, datos)[0]
