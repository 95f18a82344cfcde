"""Analyses of finished reports on small frames, null keys included."""

import datetime as dt

import pytest
from apoyo import filas, normal
from pyspark.sql import functions as F

from vitrina.functions.expresiones import texto_pct
from vitrina.functions.tallas import ORDEN_TALLAS
from vitrina.operators import filtros
from vitrina.plans import anual, catalogos, participacion, resumen

pytestmark = pytest.mark.usefixtures("sin_codegen")

RESUMEN = (
    "ini_cliente string, c_l string, local string, ciudad string, marca string, tipo_programa string, "
    "fit_estilo string, semanas string, cant_venta bigint, cant_stock bigint, pvp_prom double"
)
S1, S2 = "2024-03-03 Sem 09", "2024-03-10 Sem 10"


@pytest.fixture(scope="module")
def por_tienda(spark):
    def f(c_l, marca, fit, sem, v, s, p):
        ciudad = {"1": "001- Lima", "2": "002- Cusco", "3": "001- Lima"}[c_l]
        return ("FL", c_l, f"L{c_l}", ciudad, marca, "basico", fit, sem, v, s, p)

    datos = [
        f("1", "A", "F", S1, 1, 10, 10.0),
        f("2", "A", "F", S1, 1, 5, 15.0),  # mean 12.5: half to even is 12
        f("1", "A", "F", S2, 3, 7, 20.0),
        f("2", "A", None, S2, 4, 8, 30.0),  # null fit
        f("1", "B", "F", S2, 0, 9, 0.0),
        f("3", "B", "G", None, 5, 5, 9.0),  # unknown week
        f("3", "B", "G", S1, 2, -2, 9.0),
    ]
    return spark.createDataFrame(datos, RESUMEN)


def dicts(df):
    return [f.asDict() for f in df.collect()]


def test_resumen(por_tienda):
    claves = {(f["marca"], f["fit_estilo"], f["semanas"]): f for f in dicts(resumen.resumen_todas_tiendas(por_tienda))}
    assert set(claves) == {("A", "F", S1), ("A", "F", S2), ("B", "F", S2), ("B", "G", S1)}
    assert claves["A", "F", S1]["pvp_prom"] == 12.0
    assert claves["B", "F", S2]["pvp_prom"] == 0.0
    con_nulo = resumen.resumen_todas_tiendas(por_tienda, keep_null_fit=True)
    assert {(f["marca"], f["fit_estilo"], f["semanas"]) for f in dicts(con_nulo)} == {*claves, ("A", None, S2)}


def test_kpis(por_tienda):
    (k,) = dicts(resumen.kpis_ultima_semana(por_tienda))
    assert k["semana"] == S2
    assert (k["venta_unidades"], k["stock_unidades"]) == (7, 24)
    assert k["sell_through"] == pytest.approx(7 / 31 * 100)
    assert k["pvp_ponderado"] == pytest.approx((3 * 20 + 4 * 30) / 7)


def test_textos_kpi(por_tienda):
    grandes = por_tienda.withColumns({"cant_venta": F.col("cant_venta") * 1000, "pvp_prom": F.col("pvp_prom") * 1000})
    (t,) = dicts(resumen.textos_kpi(resumen.kpis_ultima_semana(grandes)))
    pct = 7000 / 7024 * 100
    assert t == {
        "semana": S2, "venta": "7,000", "stock": "24", "sell_through": f"{pct:.1f}%",
        "pvp": f"$ {(3 * 20 + 4 * 30) / 7 * 1000:,.0f}",
    }


def test_kpis_sin_filas(por_tienda):
    (k,) = dicts(resumen.kpis_ultima_semana(por_tienda.where("false")))
    assert k == {"semana": None, "venta_unidades": 0, "stock_unidades": 0, "sell_through": 0.0, "pvp_ponderado": 0.0}


def test_kpis_sin_unidades_positivas(por_tienda):
    (k,) = dicts(resumen.kpis_ultima_semana(por_tienda.withColumn("cant_venta", -F.col("cant_stock"))))
    assert (k["sell_through"], k["pvp_ponderado"]) == (0.0, 0.0)


def test_detalle_y_subtotales(por_tienda):
    detalle = dicts(resumen.detalle_semanas_evacuacion(por_tienda))
    assert {(f["cant_venta"], f["cant_stock"]): f["sem_evac"] for f in detalle}[0, 9] == 0.0
    assert {(f["cant_venta"], f["cant_stock"]): f["sem_evac"] for f in detalle}[2, -2] == -1.0
    assert [f["fit_estilo"] for f in detalle] == [None, "F", "F", "F", "F", "G", "G"]
    tabla = dicts(resumen.detalle_por_marca(por_tienda))
    assert [(f["marca"], f["nivel"]) for f in tabla] == [("A", 1)] + [("A", 0)] * 4 + [("B", 1)] + [("B", 0)] * 3
    assert [(f["cant_venta"], f["cant_stock"]) for f in tabla if f["nivel"]] == [(9, 30), (7, 12)]


def test_lista_tiendas(por_tienda):
    lista = dicts(catalogos.lista_tiendas(por_tienda))
    assert [f["display"] for f in lista] == ["Lima-L1", "Lima-L3", "Cusco-L2"]


def test_filtros(por_tienda):
    assert filtros.filtros_dinamicos(por_tienda, {"marca": "A", "semanas": [S1, S2]}).count() == 4
    assert filtros.filtros_dinamicos(por_tienda, {"marca": "Todos", "fit_estilo": ["G"]}).count() == 2
    assert filtros.filtros_dinamicos(por_tienda, {"fit_estilo": "None"}).count() == 0
    assert filtros.una_tienda(por_tienda, "3").count() == 2
    assert [f.opcion for f in filtros.opciones_filtro(por_tienda, "semanas", desc=True).collect()] == [S2, S1]
    assert [f.opcion for f in filtros.opciones_filtro(por_tienda, "fit_estilo").collect()] == ["F", "G"]
    todas = {(f.filtro, f.opcion) for f in filtros.opciones_filtros(por_tienda).collect()}
    assert len(todas) == 1 + 2 + 2 + 2
    vista = filtros.vista_previa(por_tienda, [F.col("cant_stock").desc(), "c_l"], 3)
    assert [f.cant_stock for f in vista.collect()] == [10, 9, 8]


# --- colour -----------------------------------------------------------------------------

COLOR = (
    "ciudad string, local string, color string, color_hexa string, c_color string, "
    "cant_venta bigint, cant_stock bigint"
)
LIMA, CUSCO = ("001- Lima", "Uno"), ("002- Cusco", "Uno")  # one name, two cities


@pytest.fixture(scope="module")
def por_color(spark):
    datos = [
        (*LIMA, "ROJO", "#f00", "1", 10, 300),
        (*LIMA, "ROJO", "#f01", "2", 0, 5),  # rare shade of a relevant name
        (*LIMA, "AZUL", None, "3", 40, 10),  # no hex
        (*LIMA, "GRIS", "#888", "5", 1, 4),  # rare
        (*CUSCO, "ROJO", "#f00", "1", 0, 200),  # no sales at all in this store
        (*CUSCO, "VERDE", "#0f0", "4", 0, 100),
        (*CUSCO, None, None, None, 30, 30),
        (*CUSCO, "ROJO", "#f00", "1", 0, 20),
    ]
    return spark.createDataFrame(datos, COLOR)


def test_participacion_color(por_color):
    filas_ = dicts(participacion.participacion_color(por_color))
    total = 10 + 520 + 5 + 5 + 100
    assert [f["c_color"] for f in filas_] == ["1", "4"]
    assert filas_[0]["pct_participacion_total"] == pytest.approx(530 / total * 100)
    assert filas_[0]["pct_participacion_venta"] == pytest.approx(100)
    assert filas_[1]["pct_participacion_stock"] == pytest.approx(100 / 620 * 100)
    todas = dicts(participacion.participacion_color(por_color, 0))
    assert sum(f["pct_participacion_total"] for f in todas) == pytest.approx(100)


def test_participacion_color_sin_unidades(por_color):
    cero = por_color.withColumns({"cant_venta": F.lit(0).cast("bigint"), "cant_stock": F.lit(0).cast("bigint")})
    assert participacion.participacion_color(cero).count() == 0
    assert {f["pct_participacion_total"] for f in dicts(participacion.participacion_color(cero, 0))} == {0.0}


def test_participacion_color_tienda(por_color):
    filas_ = {(f["ciudad"], f["c_color"]): f for f in dicts(participacion.participacion_color_tienda(por_color))}
    # AZUL has no hex and GRIS is rare; the rare shade 2 stays with its name.
    assert set(filas_) == {(LIMA[0], "1"), (LIMA[0], "2"), (CUSCO[0], "1"), (CUSCO[0], "4")}
    assert filas_[LIMA[0], "1"]["pct_participacion_venta"] == 100.0
    assert filas_[LIMA[0], "2"]["pct_participacion_stock"] == pytest.approx(5 / 305 * 100)
    assert filas_[CUSCO[0], "1"]["cant_stock"] == 220
    assert filas_[CUSCO[0], "1"]["pct_participacion_venta"] == 0.0  # store without sales


def test_etiquetas_color(por_color):
    filas_ = dicts(participacion.etiquetas_color(participacion.participacion_color(por_color, 0)))
    rojo = {f["c_color"]: f for f in filas_ if f["color"] == "ROJO"}
    assert {c: f["texto_stock"] != "" for c, f in rojo.items()} == {"1": False, "2": True}
    assert rojo["1"]["cant_stock_grupo"] == rojo["2"]["cant_stock_grupo"] == 525
    assert rojo["2"]["texto_stock"] == f"{525 / 629 * 100:.1f}%"
    orden = [f["pct_orden"] for f in filas_]
    assert orden == sorted(orden)


# --- size ---------------------------------------------------------------------------------

TALLA = "ciudad string, local string, color string, talla string, cant_venta bigint, cant_stock bigint"


@pytest.fixture(scope="module")
def por_talla(spark):
    datos = [
        (*LIMA, "ROJO-1", "S", 6, 100),
        (*LIMA, "ROJO-1", "34", 4, 50),
        (*LIMA, "AZUL-2", "ZZ", 9, 100),  # not listed, but counts for the cut
        (*LIMA, "AZUL-2", None, 3, 100),
        (*LIMA, "AZUL-2", "XL", 1, 0),  # 1 of 713 units: cut
        (*CUSCO, "ROJO-1", "S", 0, 100),
        (*CUSCO, "ROJO-1", "M", 0, 100),
        ("003- Piura", "Tres", "AZUL-2", "ZZ", 5, 35),  # only an unlisted size
    ]
    return spark.createDataFrame(datos, TALLA)


def test_participacion_talla(por_talla):
    filas_ = dicts(participacion.participacion_talla(por_talla))
    assert [f["talla"] for f in filas_] == ["XL", "M", "S", "34"]
    assert filas_[2]["pct_participacion_venta"] == pytest.approx(6 / 11 * 100)
    assert sum(f["pct_participacion_stock"] for f in filas_) == pytest.approx(100)
    textos = dicts(participacion.etiquetas_talla(participacion.participacion_talla(por_talla)))
    assert [f["texto_venta"] for f in textos] == [f"{f['cant_venta'] / 11 * 100:.1f}%" for f in filas_]
    assert [f["posicion"] for f in filas_] == [ORDEN_TALLAS.index(t) + 1 for t in ("XL", "M", "S", "34")]


def test_participacion_talla_tienda(por_talla):
    filas_ = dicts(participacion.participacion_talla_tienda(por_talla))
    celdas = {(f["ciudad"], f["talla"]): f for f in filas_}
    tallas = ["M", "S", "34"]
    assert [f["talla"] for f in filas_] == tallas * 3  # every store has the whole curve
    assert celdas[LIMA[0], "S"]["pct_participacion_venta"] == 60.0
    assert celdas[LIMA[0], "M"]["cant_stock"] == 0 and celdas[LIMA[0], "M"]["pct_participacion_stock"] == 0.0
    assert celdas[CUSCO[0], "S"]["pct_participacion_venta"] == 0.0
    assert celdas[CUSCO[0], "S"]["pct_participacion_stock"] == 50.0
    assert {f["cant_stock"] for f in filas_ if f["ciudad"] == "003- Piura"} == {0}


def test_participacion_talla_tienda_por_color(por_talla):
    filas_ = dicts(participacion.participacion_talla_tienda(por_talla, ["ROJO-1"]))
    assert {f["ciudad"] for f in filas_} == {LIMA[0], CUSCO[0]}
    assert participacion.participacion_talla_tienda(por_talla, ["NINGUNO"]).count() == 0


def test_talla_solo_no_listada(por_talla):
    assert participacion.participacion_talla_tienda(por_talla.where("talla = 'ZZ'")).count() == 0


def test_orden_tallas(spark):
    df = spark.createDataFrame([("S",), ("U",), ("XS",), (None,), ("10M",)], "talla string")
    assert [(f.talla, f.posicion) for f in participacion.orden_tallas(df).collect()][:3] == [("S", 75), ("10M", 12), ("U", 1)]
    assert len(ORDEN_TALLAS) == len(set(ORDEN_TALLAS)) == 79
    propia = participacion.orden_tallas(df, ["XS", "S"])
    assert [f.talla for f in propia.collect()][:2] == ["S", "XS"]


# --- years --------------------------------------------------------------------------------

DIARIO = (
    "ini_cliente string, marca string, tipo_programa string, fecha date, n_sem int, ano int, "
    "cant_venta bigint, cant_stock bigint"
)


@pytest.fixture(scope="module")
def diario(spark):
    def f(fecha, sem, ano, v, s, marca="A"):
        return ("FL", marca, "basico", dt.date.fromisoformat(fecha), sem, ano, v, s)

    datos = [
        f("2024-02-26", 9, 2024, 0, 100),  # Monday
        f("2024-02-26", 9, 2024, 0, 50, "B"),
        f("2024-02-28", 9, 2024, 4, 0),
        f("2024-02-28", 9, 2024, 2, 0, "B"),
        f("2024-03-03", 9, 2024, 1, 0),  # closing date with sales only: stock 0
        f("2023-02-27", 9, 2023, 2, 80),
        f("2022-02-28", 9, 2022, 90, 0),  # third year: not compared
        f("2024-03-04", 10, 2024, 7, 1),  # one year only
        f("2024-03-11", 11, 2024, 3, 1),
        f("2023-03-13", 11, 2023, 0, 1),  # no sales the year before
        f("2024-03-18", 12, 2024, 0, 1),
        f("2023-03-20", 12, 2023, 0, 1),
        f("2024-06-03", None, None, 5, 5),  # week unknown
    ]
    return spark.createDataFrame(datos, DIARIO)


def test_pivote(diario):
    filas_ = dicts(anual.pivote_semana_ano(diario))
    assert [(f["n_sem"], f["ano"]) for f in filas_] == [
        (12, 2023), (12, 2024), (11, 2023), (11, 2024), (10, 2024), (9, 2022), (9, 2023), (9, 2024),
    ]
    ultima = filas_[-1]
    assert [ultima[d] for d in anual.COLUMNAS_DIA] == [0, 0, 6, 0, 0, 0, 1]
    assert (ultima["stock_inicial"], ultima["stock_final"], ultima["venta_total"]) == (150, 0, 7)


def test_crecimiento(diario):
    filas_ = {f["n_sem"]: f for f in dicts(anual.crecimiento_anual(anual.pivote_semana_ano(diario)))}
    assert {n: f["crecimiento_pct"] for n, f in filas_.items()} == {9: 250.0, 11: 100.0, 12: 0.0}
    assert (filas_[9]["ano_actual"], filas_[9]["ano_anterior"]) == (2024, 2023)


def test_filtrar_anual(diario):
    assert anual.filtrar_anual(diario).count() == 13
    assert anual.filtrar_anual(diario, marca="B").count() == 2
    assert anual.filtrar_anual(diario, "RP").count() == 0
    dias = {f.fecha.isoformat(): f.dia_es for f in anual.con_dia(diario).collect()}
    assert dias["2024-02-28"] == "Miércoles" and dias["2024-03-03"] == "Domingo"


# --- lookups --------------------------------------------------------------------------------


def test_rango_defecto(spark):
    hoy = dt.date(2024, 3, 15)
    fines = [dt.date(2024, 1, 7) + dt.timedelta(weeks=i) for i in range(8)]
    df = spark.createDataFrame([(f"{f} Sem", f) for f in fines], "semana_formateada string, fin_semana date")

    def rango(*a, **k):
        return tuple(catalogos.rango_fechas_defecto(*a, **k).first())

    assert rango(df, hoy) == (fines[2], fines[7])
    assert rango(df.limit(3), hoy) == (fines[0], fines[2])
    assert rango(df.where("false"), hoy) == (dt.date(2024, 3, 8), hoy)
    assert rango(df, hoy, desde=fines[6], hasta=fines[1]) == (fines[1], fines[6])


def test_cliente_defecto(spark):
    df = spark.createDataFrame([("RP",), ("FL",), ("AA",)], "ini_cliente string")
    assert catalogos.cliente_defecto(df).first()[0] == "FL"
    assert catalogos.cliente_defecto(df.where("ini_cliente <> 'FL'")).first()[0] == "AA"


def test_fechas_corte(spark):
    dias = [dt.date(2024, 2, 29), dt.date(2024, 12, 30), dt.date(2021, 1, 3)]
    df = spark.createDataFrame([(d,) for d in dias], "fecha date")
    filas_ = {f.fecha: f for f in catalogos.fechas_corte(df).collect()}
    for d in dias:
        corte = d - dt.timedelta(days=d.weekday() + 2)
        assert filas_[d].semana_iso == d.isocalendar().week
        assert filas_[d].corte_actual == corte
        assert filas_[d].corte_ano_previo == corte - dt.timedelta(weeks=52)


def test_comparacion_de_filas(spark):
    df = spark.createDataFrame([(2, None), (1, "a")], "b int, a string")
    assert filas(df) == sorted([(None, 2.0), ("a", 1.0)], key=repr)
    assert normal(float("nan")) is None


def test_participacion_color_con_total_negativo(spark):
    """Shares of a total that is not above zero are 0, so no shade passes the cut."""
    filas_ = [("ROJO", "#1", "001", -50, -10), ("AZUL", "#2", "002", -30, -10)]
    df = spark.createDataFrame(filas_, "color string, color_hexa string, c_color string, cant_venta bigint, cant_stock bigint")
    assert participacion.participacion_color(df).count() == 0
    todas = dicts(participacion.participacion_color(df, 0))
    assert [f["pct_participacion_total"] for f in todas] == [0.0, 0.0]


def test_texto_pct(spark):
    """Texts round the exact binary value to the even neighbour, as printf does."""
    valores = [0.35, 0.25, 0.15, 2.675, 1.45, 8.35, 0.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in valores], "v double").select(texto_pct(F.col("v")).alias("t"))
    esperados = [None if v is None else f"{v:.1f}%" for v in valores]
    assert [f["t"] for f in dicts(df)] == esperados


def test_etiquetas_color_por_tienda(spark):
    """Each store's last shade of a name, by hex and code, carries that store's total."""
    esquema = "ciudad string, local string, color string, color_hexa string, c_color string, cant_venta bigint, cant_stock bigint, "
    esquema += "pct_participacion_venta double, pct_participacion_stock double"
    datos = [
        ("C", "L1", "ROJO", "#1", "001", 4, 1, 40.0, 10.0),
        ("C", "L1", "ROJO", "#1", "002", 1, 2, 10.0, 20.0),
        ("C", "L1", "AZUL", "#0", "009", 5, 7, 50.0, 70.0),
        ("C", "L2", "ROJO", "#1", "001", 3, 3, 100.0, 100.0),
    ]
    df = participacion.etiquetas_color(spark.createDataFrame(datos, esquema), participacion.TIENDA)
    textos = {(f["local"], f["color"], f["c_color"]): (f["texto_venta"], f["texto_stock"]) for f in dicts(df)}
    assert textos == {
        ("L1", "ROJO", "001"): ("", ""),
        ("L1", "ROJO", "002"): ("50.0%", "30.0%"),
        ("L1", "AZUL", "009"): ("50.0%", "70.0%"),
        ("L2", "ROJO", "001"): ("100.0%", "100.0%"),
    }
