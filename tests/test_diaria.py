"""Fact tables by day with their summary, the mart over them, and what is answered from both."""

import datetime as dt
import re
from decimal import Decimal
from pathlib import Path

import pytest
from apoyo import FuenteMemoria, filas, plan
from pyspark.sql import functions as F

from vitrina.params import Ventana, VentanaAnual
from vitrina.plans import catalogos, reportes
from vitrina.plans.contexto import Contexto
from vitrina.schemas import ESQUEMAS, HECHOS
from vitrina.sources import FuenteEstrella, FuenteTablas, Mart, TablaDiaria
from vitrina.sources.diaria import resumir
from vitrina.operators.hechos import MEDIDAS, movimientos_stock, movimientos_venta
from vitrina.sources import mart as modulo_mart
from vitrina.sources.mart import CLAVES, en_tramos, repartir
from vitrina.sources.tablas import escribir_hechos

P = Ventana(dt.date(2001, 8, 5), dt.date(2001, 9, 9), umbral=100)
D1, D2, D3 = dt.date(2001, 9, 1), dt.date(2001, 9, 2), dt.date(2001, 9, 3)


def ventas(spark, *hechas):
    """Sales (client, store, item, day, units) with a price."""
    return spark.createDataFrame([(*h, 100) for h in hechas], "ini_cliente string, num_local string, ean string, fecha date, cant int, precio int").selectExpr(
        *ESQUEMAS["dwh_ventas"].names[:-1], "cast(precio as decimal(12,2)) as pvp_unit"
    )


@pytest.fixture()
def tabla(spark, tmp_path):
    df = ventas(spark, ("FL", "1", "a", D1, 1), ("FL", "1", "b", D1, 2), ("RP", "2", "a", D2, 3), ("FL", "1", "a", D3, 4))
    return escribir_hechos(df, str(tmp_path / "dwh_ventas"))


def al_dia(tabla):
    """The summary and a scan agree; no summary file is left open."""
    assert filas(tabla.dias()) == filas(resumir(tabla.leer()))
    assert not tabla._pendientes()
    return {(f.fecha, f.ini_cliente): f.filas for f in tabla.dias().collect()}


def test_resumen_sigue_a_los_cambios(spark, tabla):
    assert al_dia(tabla) == {(D1, "FL"): 2, (D2, "RP"): 1, (D3, "FL"): 1}
    tabla.agregar(ventas(spark, ("FL", "1", "c", D1, 9), ("RP", "2", "c", dt.date(2001, 9, 7), 9)))
    assert al_dia(tabla) == {(D1, "FL"): 3, (D2, "RP"): 1, (D3, "FL"): 1, (dt.date(2001, 9, 7), "RP"): 1}
    tabla.reescribir(ventas(spark, ("XX", "3", "a", D2, 1), ("XX", "3", "a", D2, 1)))
    assert al_dia(tabla)[D2, "XX"] == 2 and (D2, "RP") not in al_dia(tabla)
    tabla.quitar([D1, dt.date(1999, 1, 1)])
    assert {d for d, _ in al_dia(tabla)} == {D2, D3, dt.date(2001, 9, 7)}
    tabla.agregar(ventas(spark))
    assert len(al_dia(tabla)) == 3


def test_la_huella_ve_valores(spark, tabla):
    antes = {(f.fecha, f.ini_cliente): f.huella for f in tabla.dias().collect()}
    tabla.reescribir(ventas(spark, ("FL", "1", "a", D1, 1), ("FL", "1", "b", D1, 3)))
    ahora = {(f.fecha, f.ini_cliente): f.huella for f in tabla.dias().collect()}
    assert {k for k in antes if antes[k] != ahora[k]} == {(D1, "FL")}


def test_cliente_de_un_solo_dia(spark, tabla, tmp_path):
    """A client with one day goes with it; week and client lists read no facts."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    fuente = FuenteTablas(spark, lambda n: tabla.leer() if n == "dwh_ventas" else semanas(spark), lambda n: tabla)
    ctx = Contexto(fuente)
    assert filas(catalogos.clientes(ctx)) == [("FL",), ("RP",)]
    disponibles = catalogos.semanas_disponibles(ctx)
    for lista in (catalogos.clientes(ctx), disponibles, catalogos.rango_fechas_defecto(disponibles, D3)):
        texto = plan(lista)
        assert "dwh_ventas_dias" in texto and not re.search("dwh_ventas(?!_dias)", texto)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    tabla.quitar([D2])
    assert filas(catalogos.clientes(ctx)) == [("FL",)]


def semanas(spark):
    lunes = dt.date(2001, 8, 27)
    return spark.createDataFrame([(lunes + dt.timedelta(7 * i), lunes + dt.timedelta(7 * i + 6), 35 + i, 2001) for i in range(4)], ESQUEMAS["semanas"])


def test_caida_entre_hechos_y_resumen(spark, tabla, monkeypatch):
    """A change that ends after the facts and before the summary: readers see the
    facts of its days, and the next change sums them up."""
    monkeypatch.setattr(TablaDiaria, "_resumir_de_nuevo", lambda self, dias: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tabla.agregar(ventas(spark, ("RP", "1", "c", D1, 9)))
    monkeypatch.undo()
    otra = TablaDiaria(spark, tabla.ruta)
    assert otra._pendientes() == [D1]
    assert filas(otra.dias()) == filas(resumir(otra.leer()))
    otra.agregar(ventas(spark, ("RP", "1", "c", D3, 9)))
    assert al_dia(otra)[D1, "RP"] == 1


def test_version_a_medias_no_cuenta(spark, tabla):
    version = tabla.carpetas.ultima("dias")
    media = tabla.carpetas.escribir(spark.createDataFrame([], "fecha date, ini_cliente string, filas long, huella decimal(38,0)"), "dias")
    (Path(media) / "_SUCCESS").unlink()
    assert tabla.carpetas.ultima("dias") == version and al_dia(tabla)
    tabla.agregar(ventas(spark, ("RP", "1", "c", D1, 9)))
    assert tabla.carpetas.ultima("dias") > media


def test_solo_se_listan_los_dias_pedidos(spark, tabla):
    leido = tabla.leer_dias([(D1, D1), (D3, dt.date(2001, 9, 30))])
    assert {Path(f).parent.name for f in leido.inputFiles()} == {f"fecha={D1}", f"fecha={D3}"}
    assert leido.count() == 3 and tabla.leer_dias([(dt.date(1990, 1, 1), dt.date(1990, 2, 1))]).count() == 0


# --- mart -----------------------------------------------------------------------------------


def test_tramos():
    assert en_tramos([D3, D1, dt.date(2001, 9, 7), D2]) == [(D1, D3), (dt.date(2001, 9, 7),) * 2]
    assert en_tramos([]) == []


@pytest.fixture(scope="module")
def copia(spark, datos, tmp_path_factory):
    """Facts of some months as stored tables, dimensions as given, and a mart."""
    estrella, raiz = FuenteEstrella(spark, datos), tmp_path_factory.mktemp("copia")
    meses = "fecha between date'2001-07-20' and date'2001-09-15' or fecha between date'2000-08-01' and date'2000-09-15'"
    tablas = {n: escribir_hechos(estrella.tabla(n).where(meses), f"{raiz}/{n}") for n in HECHOS}
    fuente = FuenteTablas(spark, lambda n: tablas[n].leer() if n in HECHOS else estrella.tabla(n), tablas.__getitem__)
    mart = Mart(fuente, f"{raiz}/mart")
    return tablas, fuente, mart, mart.refrescar()


INFORMES = {
    "tienda": lambda c: reportes.ventas_por_tienda(c, P),
    "color": lambda c: reportes.ventas_por_color(c, P.ultima_semana_de_stock(), solo_validas=True),
    "talla": lambda c: reportes.ventas_por_talla(c, P.ultima_semana_de_stock()),
    "detalle": lambda c: reportes.ventas_stock_detalle(c, P),
    "ano": lambda c: reportes.ventas_sem_ano(c, VentanaAnual(umbral=100, as_of=dt.date(2001, 9, 10))),
    "pagina": lambda c: reportes.pagina_resumen(c, P),
}


def carpetas(mart):
    return {p.parent.name: {f.name for f in p.parent.glob("part-*")} for p in Path(mart.ruta).glob("fecha=*/part-*")}


@pytest.mark.parametrize("informe", INFORMES)
def test_informes_desde_el_mart(copia, informe):
    _, fuente, mart, _ = copia
    hecho, sumado = (INFORMES[informe](Contexto(f)) for f in (fuente, mart))
    assert filas(sumado) == filas(hecho) != []


def test_un_dia_cambiado_escribe_una_carpeta(spark, datos, copia):
    tablas, fuente, mart, primero = copia
    assert not primero.quitados and len(primero.escritos) == len(carpetas(mart))
    antes = carpetas(mart)
    assert mart.refrescar().escritos == [] and carpetas(mart) == antes
    dia, otro = dt.date(2001, 8, 20), dt.date(2001, 8, 29)
    dado = FuenteEstrella(spark, datos).tabla("dwh_stock").where(f"fecha = date'{dia}'")
    tablas["dwh_stock"].reescribir(dado.selectExpr("ini_cliente", "num_local", "ean", "fecha", "cant + 7 as cant"))
    for t in tablas.values():
        t.quitar([otro])
    refresco = mart.refrescar()
    assert (refresco.escritos, refresco.quitados) == ([dia], [otro])
    ahora = carpetas(mart)
    assert {n for n in ahora if ahora[n] != antes[n]} == {f"fecha={dia}"} and set(antes) - set(ahora) == {f"fecha={otro}"}
    assert filas(INFORMES["tienda"](Contexto(mart))) == filas(INFORMES["tienda"](Contexto(fuente)))


def test_mart_sin_hechos(spark, tmp_path):
    fuente = FuenteMemoria(spark)
    mart = Mart(fuente, str(tmp_path / "mart"))
    assert mart.refrescar().escritos == []
    assert reportes.ventas_por_tienda(Contexto(mart), P).count() == 0


# --- tasks of a refresh -------------------------------------------------------------------


def test_reparto_de_dias():
    hallado = [(r.fecha, r.primera, r.cuantas) for r in repartir({D2: 25, D1: 4, D3: 3, dt.date(2001, 9, 4): 6, dt.date(2001, 9, 5): 2}, 10, 9)]
    assert hallado == [(D1, 0, 1), (D2, 1, 3), (D3, 4, 1), (dt.date(2001, 9, 4), 4, 1), (dt.date(2001, 9, 5), 5, 1)]
    assert repartir({}, 10, 9) == []


def test_refresco_con_una_sola_mezcla(copia):
    """Raw rows go once to the task that sums and writes their day; no sums before, no second shuffle."""
    mart = copia[2]
    texto = plan(mart._sumas({D1: 10, D2: 10}))
    mezclas = re.findall(r"Exchange (?!SinglePartition)\w+", texto)
    assert [m for m in mezclas if "Broadcast" not in m] == ["Exchange shufflepartitionidpassthrough"]
    assert "HashAggregate" in texto.split("Exchange shuffle")[0] and "Aggregate" not in texto.split("Exchange shuffle")[1]


def test_dias_grandes_y_claves_repetidas(spark, tmp_path, monkeypatch):
    """Days over several tasks, a key with most of a day's rows, null keys and values: one row a key."""
    monkeypatch.setattr(modulo_mart, "FILAS_POR_TAREA", 8)
    hechas = [("FL", "1", "a", D1, 2)] * 30 + [("FL", None, "a", D1, 3), (None, "1", "a", D1, 4), ("RP", "1", "a", D1, None)]
    hechas += [("FL", str(i), "b", dia, i) for i in range(12) for dia in (D1, D2)] + [("FL", "1", "a", None, 5)]
    fuente = FuenteMemoria(spark, dwh_ventas=[(*h, Decimal(100)) for h in hechas], dwh_stock=[h for h in hechas if h[1]])
    mart = Mart(fuente, str(tmp_path / "mart"))
    assert mart._calientes({D1: 80})
    assert mart.refrescar().escritos == [D1, D2]
    movs = movimientos_venta(fuente.tabla("dwh_ventas"), CLAVES).unionByName(movimientos_stock(fuente.tabla("dwh_stock"), CLAVES)).where("fecha is not null")
    esperadas = movs.groupBy(*CLAVES).agg(*[F.sum(m).alias(m) for m in MEDIDAS])
    assert filas(mart.leer().select(*esperadas.columns)) == filas(esperadas)


def test_cambios_leen_solo_sus_dias(spark):
    """The changed copy reads each fact whole once; its changes ask the source for their days."""
    import __spark_entry__ as entrada

    class Contada(FuenteMemoria):
        enteras, pedidas = [], []

        def tabla(self, nombre):
            self.enteras.append(nombre)
            return super().tabla(nombre)

        def _hechos(self, nombre, cliente, rangos):
            self.pedidas.append((nombre, cliente, rangos))
            df = super().tabla(nombre).where(F.col("fecha").between(*rangos[0]))
            return df if cliente is None else df.where(F.col("ini_cliente") == cliente)

    hechas = [(c, "1", "a", d, 2) for c in ("FL", "RP") for d in (entrada.CAMBIADO, entrada.QUITADO, entrada.NUEVO)]
    fuente = Contada(spark, dwh_ventas=[(*h, Decimal(100)) for h in hechas], dwh_stock=hechas)
    copia = entrada._Copia(Contexto(fuente))
    assert sorted(fuente.enteras) == sorted(HECHOS)
    dias = [(entrada.CAMBIADO,) * 2], [(entrada.NUEVO,) * 2]
    assert fuente.pedidas == [(n, c, r) for n in HECHOS for c, r in zip((None, "RP"), dias)]
    hallado = {(f.ini_cliente, f.fecha): (f.cant_venta, f.n_stock) for f in copia.mart.leer().collect()}
    assert hallado == {
        ("FL", entrada.CAMBIADO): (4, 1), ("RP", entrada.CAMBIADO): (2, 1), ("FL", entrada.NUEVO): (2, 1), ("RP", entrada.NUEVO): (4, 2),
    }
