"""Interval overlap, hot keys, several windows, one pass over the page, cascaded options."""

import datetime as dt
import random
import re

import pytest
from apoyo import FuenteMemoria, filas, plan

import __spark_entry__ as contrato
from vitrina.operators import calientes
from vitrina.operators.intervalos import unir_solapados
from vitrina.params import Ventana, VentanaAnual
from vitrina.plans import anual, catalogos, reportes, resumen
from vitrina.plans.contexto import Contexto
from vitrina.schemas import ESQUEMAS
from vitrina.sources import FuenteEstrella, FuenteTablas
from vitrina.sources.tablas import escribir_hechos

P = Ventana(dt.date(2001, 8, 5), dt.date(2001, 9, 9), umbral=100)
HOY = dt.date(2001, 9, 10)


@pytest.fixture(scope="module")
def estrella(spark, datos):
    return FuenteEstrella(spark, datos)


# --- intervals ------------------------------------------------------------------------------


@pytest.mark.parametrize("ancho", [1, 7, 56])
def test_solapados(spark, ancho):
    """All overlaps once, before 1970 too; ranges of one day, repeated, empty and unknown."""
    azar = random.Random(7)
    base = dt.date(1969, 12, 1)

    def tramos(n):
        salida = []
        for i in range(n):
            desde = base + dt.timedelta(azar.randrange(120))
            salida.append((i, desde, desde + dt.timedelta(azar.choice([0, 0, 3, 40, 200, -1]))))
        return salida + [(n, None, base), (n + 1, base, None), salida[0]]

    a, b = tramos(40), tramos(30)
    izquierda = spark.createDataFrame(a, "i int, a date, b date")
    derecha = spark.createDataFrame(b, "j int, c date, d date")
    unidos = unir_solapados(izquierda, derecha, desde=("a", "c"), hasta=("b", "d"), ancho=ancho)
    esperados = [
        (i, j)
        for i, a1, a2 in a
        for j, b1, b2 in b
        if None not in (a1, a2, b1, b2) and a1 <= a2 and b1 <= b2 and a1 <= b2 and b1 <= a2
    ]
    assert sorted((f.i, f.j) for f in unidos.collect()) == sorted(esperados)


def test_semanas_por_tienda_sin_bucle(spark, datos):
    texto = plan(contrato.queries()["semanas_por_tienda"](spark, datos))
    assert "NestedLoop" not in texto and "Cartesian" not in texto
    assert texto.count("lineitem.parquet") == 1


def test_listas_sin_hechos(spark, datos):
    for clave in ("semanas_disponibles", "rango_fechas_defecto", "clientes", "cliente_defecto"):
        assert "lineitem" not in plan(contrato.queries()[clave](spark, datos)), clave


# --- hot items -------------------------------------------------------------------------------


def _con_moda(spark, n):
    """A catalogue in which one item has half of the rows, with repeated and unknown items."""
    azar, dia = random.Random(5), dt.date(2001, 9, 3)
    eans = ["moda" if azar.random() < 0.5 else f"e{azar.randrange(40)}" for _ in range(n)] + [None, "fuera"]
    ventas = [("FL", str(i % 5), e, dia + dt.timedelta(i % 6), i % 4 + 1, None) for i, e in enumerate(eans)]
    stock = [("FL", str(i % 7), e, dia + dt.timedelta(6), i % 9) for i, e in enumerate(eans)]
    cat = [(e, f"S{e}", f"R{i % 3}", f"B{i % 4}", "J000001", f"{i % 6:03}", str(30 + i % 5), "d") for i, e in enumerate(["moda", "moda", *(f"e{k}" for k in range(40))])]
    return FuenteMemoria(
        spark,
        dwh_ventas=ventas,
        dwh_stock=stock,
        cat_sku=cat,
        monitoreo=[(f"R{i}", f"B{j}", "basico", "F") for i in range(3) for j in range(4)],
        tiendas=[("FL", i, f"L{i}", "000- C", "TIENDA", "A", str(i)) for i in range(7)],
        semanas=[(dia, dia + dt.timedelta(6), 36, 2001)],
        cod_color=[(f"{i:03}", f"C{i}", "#00") for i in range(6)],
    )


def test_articulo_de_moda(spark):
    """One item with half of the rows: same rows, and both joins in the plan."""
    fuente = _con_moda(spark, 400)
    p = Ventana(dt.date(2001, 9, 3), dt.date(2001, 9, 9), umbral=1)
    sin_difundir = Contexto(fuente, limite_difusion=0)
    assert sin_difundir.articulos_calientes("FL", [p.rango_ventas], [p.rango_stock]) == ["moda"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for informe in (reportes.ventas_por_tienda, reportes.ventas_por_color, reportes.ventas_stock_detalle):
            esperadas = filas(informe(Contexto(fuente), p))
            for limite in (0, 6000):
                df = informe(Contexto(fuente, limite_difusion=limite), p)
                assert filas(df) == esperadas != []
        medio = reportes.ventas_por_color(Contexto(fuente, limite_difusion=2500), p)
        texto = medio._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert re.search(r"BroadcastHashJoin \[ean", texto) and re.search(r"SortMergeJoin \[ean", texto)


def test_valores_calientes(spark):
    df = spark.range(1000).selectExpr("case when id % 2 = 0 then 'a' when id % 7 = 0 then null else concat('x', id) end as k")
    assert calientes.valores_calientes(df, "k", 8) == ["a"]
    assert calientes.valores_calientes(df.where("k <> 'a'"), "k", 8) == []
    assert calientes.valores_calientes(df.limit(0), "k", 8) == []
    dentro, fuera = calientes.separar(df, "k", ["a"])
    assert (dentro.count(), fuera.count()) == (500, 500)


# --- one pass over the page -----------------------------------------------------------------------


@pytest.mark.parametrize("limite", [None, 0])
@pytest.mark.parametrize("solo_validas", [False, True])
def test_pagina_igual_a_sus_informes(estrella, limite, solo_validas):
    ctx = Contexto(estrella) if limite is None else Contexto(estrella, limite_difusion=limite)
    partes = reportes.informes_de_pagina(ctx, P, solo_validas=solo_validas)
    corta = P.ultima_semana_de_stock()
    enteros = {
        "tienda": reportes.ventas_por_tienda(ctx, P, solo_validas=solo_validas),
        "color": reportes.ventas_por_color(ctx, corta, solo_validas=solo_validas),
        "talla": reportes.ventas_por_talla(ctx, corta, solo_validas=solo_validas),
    }
    for nombre, entero in enteros.items():
        assert partes[nombre].columns == entero.columns
        assert filas(partes[nombre]) == filas(entero) != [], nombre


def test_pagina_de_ventana_corta(estrella):
    """A window shorter than the week of stock that colour and size look at."""
    corta = Ventana(dt.date(2001, 9, 7), dt.date(2001, 9, 9), umbral=100)
    partes = reportes.informes_de_pagina(Contexto(estrella), corta)
    assert filas(partes["tienda"]) == filas(reportes.ventas_por_tienda(Contexto(estrella), corta))
    assert filas(partes["talla"]) == filas(reportes.ventas_por_talla(Contexto(estrella), corta.ultima_semana_de_stock()))


def test_pagina_lee_cada_hecho_una_vez(spark, datos):
    texto = plan(contrato.queries()["pagina_resumen"](spark, datos))
    assert texto.count("lineitem.parquet") == 2 and texto.count("Expand") == 1
    assert re.findall(r"Exchange (hash|range|Single|RoundRobin)\w*", texto) == ["hash"]


def test_detalle_por_marca_lee_una_vez(spark, datos):
    ctx, umbral = contrato._contexto(spark, datos)
    reporte = contrato._por_tienda(ctx, umbral)
    texto = plan(resumen.detalle_por_marca(reporte))
    assert texto.count("FileScan") == 1 and texto.count("Expand") == 1


# --- several windows --------------------------------------------------------------------------


def test_varias_ventanas(spark, estrella):
    pedidas = [("FL", HOY), ("RP", HOY), ("FL", dt.date(2001, 6, 20)), ("FL", dt.date(2001, 6, 21)), ("XX", HOY)]
    ventanas = spark.createDataFrame(pedidas, "ini_cliente string, as_of date")
    for solo_validas in (False, True):
        varias = filas(reportes.ventas_sem_ano_varias(Contexto(estrella), ventanas, umbral=100, semanas_stock=2, solo_validas=solo_validas))
        nombres = sorted(["corte", *reportes.ventas_sem_ano(Contexto(estrella), VentanaAnual(as_of=HOY)).columns])
        for cliente, as_of in pedidas[:3]:
            p = VentanaAnual(cliente=cliente, umbral=100, semanas_stock=2, as_of=as_of)
            sola = filas(reportes.ventas_sem_ano(Contexto(estrella), p, solo_validas=solo_validas))
            i, j = nombres.index("corte"), nombres.index("ini_cliente")
            assert [f[:i] + f[i + 1 :] for f in varias if f[i] == p.corte and f[j] == cliente] == sola != []
        assert {f[nombres.index("ini_cliente")] for f in varias} == {"FL", "RP"}


def test_poda_dinamica(spark, estrella, tmp_path):
    """The days of the windows prune the folders of both facts while the query runs."""
    for nombre in ("dwh_ventas", "dwh_stock"):
        escribir_hechos(estrella.tabla(nombre).where("fecha between date'2001-08-01' and date'2001-09-15'"), str(tmp_path / nombre))
    fuente = FuenteTablas(spark, lambda n: spark.read.parquet(str(tmp_path / n)) if n.startswith("dwh") else estrella.tabla(n))
    ventanas = spark.createDataFrame([("FL", HOY)], "ini_cliente string, as_of date")
    df = reportes.ventas_sem_ano_varias(Contexto(fuente), ventanas, umbral=100)
    texto = plan(df)
    assert len(re.findall(r"PartitionFilters: \[[^\]]*dynamicpruning\w*\(fecha", texto)) == 2
    assert "NestedLoop" not in texto


# --- cascade ------------------------------------------------------------------------------------


@pytest.mark.parametrize("cliente, marca", [("Todos", "Todos"), ("FL", "Todos"), ("Todos", "M2"), ("FL", "M2"), ("FL", "nada")])
def test_opciones_cascada(spark, cliente, marca):
    azar = random.Random(3)
    datos = [(azar.choice(["FL", "RP", None]), azar.choice(["M1", "M2", None]), azar.choice(["a", "b", "c", None])) for _ in range(60)]
    df = spark.createDataFrame(datos, "ini_cliente string, marca string, tipo_programa string")
    hechas = {(f.filtro, f.opcion): f.filas for f in anual.opciones_cascada(df, cliente, marca).collect()}
    esperadas, quedan = {}, datos
    for i, (columna, valor) in enumerate((("ini_cliente", cliente), ("marca", marca), ("tipo_programa", "Todos"))):
        for fila in quedan:
            if fila[i] is not None:
                esperadas[columna, fila[i]] = esperadas.get((columna, fila[i]), 0) + 1
        quedan = [f for f in quedan if valor in ("Todos", f[i])]
    assert hechas == esperadas


def test_semanas_por_tienda_sin_ventas(spark):
    assert catalogos.semanas_por_tienda(Contexto(FuenteMemoria(spark))).count() == 0
    assert set(ESQUEMAS) >= {"semanas"}
