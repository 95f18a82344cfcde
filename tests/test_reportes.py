"""Reports against nested-loop brute force on small frames with awkward rows:
repeated dimension keys, null fit, unknown items, stores, colours and weeks,
negative units, groups on the threshold."""

import datetime as dt
from decimal import Decimal

import pytest
from apoyo import FuenteMemoria, articulos_de, filas, grupos_de, lineas, normal, ordenadas, redondeo
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vitrina.params import Ventana, VentanaAnual, VentanaReciente
from vitrina.plans import reportes
from vitrina.plans.contexto import Contexto

pytestmark = pytest.mark.usefixtures("sin_codegen")

LUN = dt.date(2024, 2, 26)  # the week holds 29 February


def dia(n):
    return LUN + dt.timedelta(days=n)


DIMENSIONES = dict(
    cat_sku=[
        ("e1", "S1", "mod1", "B1", "J000001xx", "001", "M", "uno"),
        ("e2", "S2", "mod2", "B1", "J000003xx", "099", "34", "dos"),  # unknown colour, exception
        ("e3", "S3", "mod3", "B2", "J000001yy", "002", "ZZ", "tres"),
        ("e3", "S3b", "mod1", "B1", "J000001yy", None, None, "tres bis"),  # repeated item
        ("e4", "S4", "modX", "B9", None, "001", "M", "sin programa"),
    ],
    monitoreo=[
        ("mod1", "B1", "basico", "FIT"),
        ("mod2", "B1", "moda", None),
        ("mod3", "B2", "basico", None),
        ("mod3", "B2", "basico", "SLIM"),  # two programmes for one model
    ],
    marca=[("B1", "N1"), ("B2", "N2"), ("B2", "N2")],  # repeated correction
    marca_subclase=[("FL", "J000003", "EXC"), ("RP", "J000001", "OTRA")],
    cod_color=[("001", "ROJO", "#f00"), ("002", "AZUL", None)],
    ecat_fala=[("e1", "MAD1"), ("e1", "MAD2"), ("e9", "MAD9")],
    tiendas=[
        ("FL", 1, "Uno", "001- Lima", "TIENDA", "A", "1"),
        ("FL", 2, "Dos", "002- Cusco", "BODEGA", "A", "2"),
        ("FL", 3, "Uno", "003- Piura", "TIENDA", "A", "3"),
        ("FL", 3, "Uno", "003- Piura", "TIENDA", "A", "3"),  # repeated store
        ("RP", 1, "Ajena", "001- Lima", "TIENDA", "A", "1"),
    ],
    semanas=[(LUN, dia(6), 9, 2024), (dia(7), dia(13), 10, 2024)],
)

VENTAS = [
    ("FL", "1", "e1", dia(0), 2, Decimal("10.50")),
    ("FL", "1", "e1", dia(3), -1, Decimal("11.00")),
    ("FL", "1", "e2", dia(8), 3, Decimal("7.25")),
    ("FL", "3", "e3", dia(2), 1, Decimal("99.99")),
    ("FL", "3", "e9", dia(2), 4, Decimal("5.00")),  # not in the catalogue
    ("FL", "2", "e1", dia(2), 4, Decimal("5.00")),  # warehouse
    ("FL", "7", "e1", dia(9), 1, Decimal("5.00")),  # unknown store
    ("FL", "1", "e4", dia(15), 1, Decimal("0.40")),  # week without calendar row
    ("FL", "1", "e1", dia(16), 5, None),
    ("FL", "3", None, dia(2), 1, Decimal("1.00")),
    ("RP", "1", "e1", dia(2), 1, Decimal("3.00")),
]
STOCK = [
    ("FL", "1", "e1", dia(0), 5),
    ("FL", "2", "e1", dia(20), 60),  # warehouses count for the groups
    ("FL", "1", "e2", dia(20), 100),
    ("FL", "3", "e3", dia(20), 40),
    ("FL", "3", "e3", dia(13), 7),
    ("FL", "3", "e4", dia(20), 500),  # no programme: never valid
    ("FL", "1", "e9", dia(13), 3),
    ("RP", "1", "e1", dia(20), 900),
]
P = Ventana(dia(0), dia(20), "FL", umbral=100)


@pytest.fixture(scope="module")
def fuente(spark):
    return FuenteMemoria(spark, dwh_ventas=VENTAS, dwh_stock=STOCK, **DIMENSIONES)


@pytest.fixture(scope="module", params=[None, 0], ids=["difundido", "sin_difundir"])
def ctx(fuente, request):
    return Contexto(fuente) if request.param is None else Contexto(fuente, limite_difusion=0)


def lista_lineas(fuente, p=P, **opciones):
    return list(lineas(fuente, p, **opciones))


def agrupar(filas_, claves, precio):
    """Sums as in SQL: null amounts are skipped, and null if there is no other."""
    suma = {}
    for f in filas_:
        v, s, imp = suma.get(claves(f), (0, 0, None))
        if f["importe"] is not None:
            imp = (imp or Decimal(0)) + f["importe"]
        suma[claves(f)] = (v + f["v_cant"], s + f["s_cant"], imp)
    return ordenadas(
        tuple(map(normal, (*k, v, s, *precio(imp, v)))) for k, (v, s, imp) in suma.items()
    )


def obtenidas(df, columnas):
    return ordenadas(tuple(normal(f[c]) for c in columnas) for f in df.collect())


def etiqueta(f):
    s = f["s"]
    return f"{s['dia_fin']} Sem {s['n_sem']:02d}" if s else None


def test_grupos(ctx, fuente):
    grupos = reportes.grupos_del_dia(ctx, "FL", dia(20), 100)
    assert {tuple(g) for g in grupos.collect()} == grupos_de(fuente, "FL", dia(20), 100)
    assert ("EXC", "moda", None) in {tuple(g) for g in grupos.collect()}


def test_por_tienda(ctx, fuente):
    def claves(f):
        g = (f["marca"], f["tipo"], f["fit"]) if f["valido"] else (None, None, None)
        return ("FL", f["num_local"], f["t"]["local"], f["t"]["ciudad"], *g, etiqueta(f))

    esperado = agrupar(lista_lineas(fuente), claves, lambda i, v: (0.0 if v == 0 else redondeo(i, v),))
    columnas = (
        "ini_cliente c_l local ciudad marca tipo_programa fit_estilo semanas cant_venta cant_stock pvp_prom"
    ).split()
    df = reportes.ventas_por_tienda(ctx, P)
    assert df.columns == columnas
    assert obtenidas(df, columnas) == esperado
    validas = [f for f in esperado if f[4] is not None]
    assert obtenidas(reportes.ventas_por_tienda(ctx, P, solo_validas=True), columnas) == validas
    assert any(f[6] is None for f in validas), "a valid group without fit"


def colores(fuente, filas_):
    for f in filas_:
        codigos = [c for c in fuente.dicts("cod_color") if c["codigo"] == f["e"].get("cod_color")]
        for c in codigos or [{}]:
            yield {**f, "k": c}


def test_por_color_y_talla(ctx, fuente):
    p = P.ultima_semana_de_stock()
    base = list(colores(fuente, lista_lineas(fuente, p)))

    def comunes(f):
        return ("FL", f["tipo"], f["num_local"], f["t"]["local"], f["t"]["ciudad"])

    def grupo(f):
        return (f["marca"], etiqueta(f), f["fit"]) if f["valido"] else (None, etiqueta(f), None)

    df = reportes.ventas_por_color(ctx, p)
    esperado = agrupar(
        base,
        lambda f: (*comunes(f), *grupo(f), f["k"].get("color"), f["e"].get("cod_color"), f["k"].get("color_hexa")),
        lambda i, v: (),
    )
    assert obtenidas(df, df.columns) == esperado

    df = reportes.ventas_por_talla(ctx, p)
    esperado = agrupar(
        base,
        lambda f: (
            *comunes(f),
            *grupo(f),
            f"{f['k']['color']}-{f['e']['cod_color']}" if f["k"] else None,
            f["e"].get("talla"),
        ),
        lambda i, v: (),
    )
    assert obtenidas(df, df.columns) == esperado


def test_detalle(ctx, fuente):
    base = []
    for f in colores(fuente, lista_lineas(fuente, tiendas_solo=False)):
        for r in [r for r in fuente.dicts("ecat_fala") if r["upc"] == f["ean"]] or [{}]:
            base.append({**f, "r": r})

    def claves(f):
        e, k, lunes, sem = f["e"], f["k"], f["lunes"], f["s"]
        codigo = k.get("codigo") if f["origen"] == "S" else e.get("cod_color")
        b = f"{lunes:%y}/{sem['n_sem']:02d} - {lunes:%m/%d}" if sem else None
        return (
            "FL", f["num_local"], f["t"].get("local"), f["t"].get("ciudad"), f["ean"], e.get("sku"),
            f["r"].get("sku_madre"), e.get("descripcion_nueva"), e.get("ref_modelo"),
            f["marca"] if f["valido"] else None, e.get("categoria") and e["categoria"][:7],
            f["tipo"], f["fit"], k.get("color"), codigo, k.get("color_hexa"), e.get("talla"), lunes, b,
        )

    def precio(importe, v):
        valor = redondeo(importe, v) if v else None
        return (valor or None,)

    df = reportes.ventas_stock_detalle(ctx, P)
    esperado = agrupar(base, claves, precio)
    assert obtenidas(df, df.columns) == esperado
    validas = reportes.ventas_stock_detalle(ctx, P, solo_validas=True)
    assert obtenidas(validas, df.columns) == [f for f in esperado if f[9] is not None] != []


def test_detalle_separa_color_desconocido(ctx):
    e2 = reportes.ventas_stock_detalle(ctx, P).where("ean = 'e2'").collect()
    assert {(f.cod_color, f.cant_venta, f.cant_stock) for f in e2} == {("099", 3, 0), (None, 0, 100)}


def test_8_semanas(ctx, fuente):
    hoy = dia(20) + dt.timedelta(days=1)  # Monday; groups measured that day
    p = VentanaReciente("FL", 1, hoy)
    assert reportes.ventas_stock_8sem(ctx, p).count() == 0  # no stock on the Monday
    lunes_stock = [*fuente.datos["dwh_stock"], ("FL", "1", "e1", hoy, 9), ("FL", "1", "e3", hoy, 2)]
    otra = FuenteMemoria(fuente.spark, **{**fuente.datos, "dwh_stock": lunes_stock})
    df = reportes.ventas_stock_8sem(Contexto(otra), p)
    ventana = Ventana(p.rango[0], p.rango[1], "FL", umbral=1)
    base = [f for f in lineas(otra, ventana, tiendas_solo=False) if f["valido"]]

    def claves(f):
        sem, lunes = f["s"], f["lunes"]
        b = f"{lunes:%y}/{sem['n_sem']:02d} - {lunes:%m/%d}" if sem else None
        return (
            "FL", f["num_local"], f["t"].get("local"), f["ean"], f["e"].get("sku"), f["e"].get("ref_modelo"),
            f["marca"], f["tipo"], lunes, b,
        )

    esperado = agrupar(base, claves, lambda i, v: (redondeo(i, v) if v else None,))
    assert obtenidas(df, df.columns) == esperado
    assert esperado


def test_semana_ano(ctx, fuente):
    """Stock of invalid groups drops out, their sales stay without brand."""
    p = VentanaAnual("FL", 3, 3, 100, dia(21))
    ventana = Ventana(p.corte - dt.timedelta(weeks=3), p.corte, "FL", umbral=100)
    stock = [*fuente.datos["dwh_stock"], ("FL", "1", "e1", p.corte, 100), ("FL", "1", "e2", p.corte, 99)]
    otra = FuenteMemoria(fuente.spark, **{**fuente.datos, "dwh_stock": stock})
    limite = ctx.almacen.limite
    df = reportes.ventas_sem_ano(Contexto(otra, limite_difusion=limite), p)
    base = [f for f in lineas(otra, ventana) if f["valido"] or f["origen"] == "V"]

    def claves(f):
        tienda = f"{f['t']['ciudad'][5:25]} - {f['t']['local']}"
        return (
            "FL", f["tipo"], f["num_local"], tienda, f["marca"] if f["valido"] else None,
            f["fecha"], f["s"].get("n_sem"), f["s"].get("ano"),
        )

    esperado = agrupar(base, claves, lambda i, v: ())
    assert obtenidas(df, df.columns) == esperado
    assert any(f[4] is None and f[8] for f in esperado), "sales of an invalid group"
    solo = reportes.ventas_sem_ano(Contexto(otra), p, solo_validas=True)
    assert obtenidas(solo, solo.columns) == [f for f in esperado if f[4] is not None]


movimiento = st.tuples(
    st.just("FL"),
    st.sampled_from("1237"),
    st.sampled_from(["e1", "e2", "e3", "e4", "e9"]),
    st.integers(0, 20).map(dia),
    st.integers(-3, 60),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(movimiento, max_size=12), st.lists(movimiento, max_size=12), st.sampled_from([0, 1 << 26]))
def test_unidades_se_conservan(spark, ventas, stock, limite):
    """Any data: the report's totals are those of the joined rows, both ways."""
    ventas = [(*v, Decimal(v[4] + 5)) for v in ventas]
    fuente = FuenteMemoria(spark, dwh_ventas=ventas, dwh_stock=stock, **DIMENSIONES)
    p = Ventana(dia(0), dia(20), "FL", umbral=50)
    por_tienda = filas(reportes.ventas_por_tienda(Contexto(fuente, limite_difusion=limite), p).select("cant_venta", "cant_stock"))
    base = list(lineas(fuente, p))
    assert sum(f[1] for f in por_tienda) == sum(f["v_cant"] for f in base)
    assert sum(f[0] for f in por_tienda) == sum(f["s_cant"] for f in base)


def test_marca_efectiva(ctx, fuente):
    esperado = {f["marca"] for f in articulos_de(fuente, "FL", {"ean": "e2"})}
    assert esperado == {"EXC"}
    marcas = {f.ean: f.marca_calc for f in ctx.articulos("FL").df.collect()}
    assert marcas["e2"] == "EXC" and marcas["e1"] == "N1" and marcas["e4"] == "B9"
