"""Helpers: comparable rows, an in-memory source and a brute-force join."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type

from vitrina.schemas import ESQUEMAS
from vitrina.sources.tablas import Fuente


def normal(valor):
    if valor is None or valor != valor:
        return None
    if isinstance(valor, bool):
        return valor
    if isinstance(valor, (int, float, Decimal)):
        return round(float(valor), 6)
    if isinstance(valor, dt.datetime):
        return valor.date()
    return valor


def filas(df) -> list[tuple]:
    """Rows as a sorted multiset, columns by name."""
    nombres = sorted(df.columns)
    return ordenadas(tuple(normal(f[n]) for n in nombres) for f in df.collect())


def ordenadas(tuplas) -> list[tuple]:
    return sorted(tuplas, key=repr)


def plan(df) -> str:
    """Final physical plan after running the query, without the initial one."""
    df.collect()
    texto = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"\+- == Initial Plan ==.*?(?=Subquery|\Z)", "", texto, flags=re.S)


class FuenteMemoria(Fuente):
    """Tables given as lists of tuples; tables not given are empty."""

    def __init__(self, spark, **tablas):
        self.spark = spark
        self.datos = {n: tablas.get(n, []) for n in ESQUEMAS}

    def tabla(self, nombre):
        esquema = ESQUEMAS[nombre]
        columnas = list(zip(*self.datos[nombre])) or [()] * len(esquema)
        arrow = pa.table(
            [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columnas, esquema)], esquema.names
        )
        return self.spark.createDataFrame(arrow)

    def dicts(self, nombre):
        nombres = ESQUEMAS[nombre].names
        return [dict(zip(nombres, fila)) for fila in self.datos[nombre]]


# --- brute force -----------------------------------------------------------------


def _lunes(dia):
    return dia - dt.timedelta(days=dia.weekday())


def _izquierda(fila, candidatas, igual, prefijo):
    """Left join of one row: every match, or one row without values."""
    halladas = [c for c in candidatas if igual(c)]
    return [{**fila, prefijo: h} for h in halladas or [{}]]


def _eq(a, b):
    return a is not None and a == b


def articulos_de(fuente, cliente, fila):
    """A fact row with all its catalogue matches, nested loops throughout."""
    salida = []
    for f in _izquierda(fila, fuente.dicts("cat_sku"), lambda e: _eq(e["ean"], fila["ean"]), "e"):
        e = f["e"]
        sub = e.get("categoria") and e["categoria"][:7]
        for f1 in _izquierda(
            f,
            fuente.dicts("marca_subclase"),
            lambda x: x["ini_cliente"] == cliente and _eq(x["subcategoria"], sub),
            "x",
        ):
            for f2 in _izquierda(
                f1,
                fuente.dicts("monitoreo"),
                lambda m: _eq(m["modelo"], e.get("ref_modelo")) and _eq(m["marca"], e.get("marca")),
                "m",
            ):
                for f3 in _izquierda(
                    f2, fuente.dicts("marca"), lambda c: _eq(c["marca_bd"], e.get("marca")), "c"
                ):
                    marca = f3["x"].get("marca") or f3["c"].get("new_marca") or e.get("marca")
                    salida.append(
                        {**f3, "marca": marca, "tipo": f3["m"].get("tipo"), "fit": f3["m"].get("fit")}
                    )
    return salida


def grupos_de(fuente, cliente, dia, umbral):
    suma = {}
    for s in fuente.dicts("dwh_stock"):
        if s["ini_cliente"] == cliente and s["fecha"] == dia:
            for f in articulos_de(fuente, cliente, s):
                clave = (f["marca"], f["tipo"], f["fit"])
                suma[clave] = suma.get(clave, 0) + s["cant"]
    return {k for k, v in suma.items() if v >= umbral}


def lineas(fuente, p, *, tiendas_solo=True):
    """Joined fact rows of a window, with store, group and week."""
    validos = grupos_de(fuente, p.cliente, p.fecha_fin, p.umbral)
    hechos = [("V", v, p.rango_ventas) for v in fuente.dicts("dwh_ventas")]
    hechos += [("S", s, p.rango_stock) for s in fuente.dicts("dwh_stock")]
    for origen, h, (desde, hasta) in hechos:
        if h["ini_cliente"] != p.cliente or not desde <= h["fecha"] <= hasta:
            continue
        for f in articulos_de(fuente, p.cliente, h):
            locales = [
                t
                for t in fuente.dicts("tiendas")
                if t["codigo"] == h["num_local"]
                and t["ini_cliente"] == p.cliente
                and (t["tipo"] == "TIENDA" or not tiendas_solo)
            ]
            for t in locales or ([] if tiendas_solo else [{}]):
                grupo = (f["marca"], f["tipo"], f["fit"])
                valido = f["marca"] is not None and f["tipo"] is not None and grupo in validos
                lunes = _lunes(h["fecha"])
                for s in [s for s in fuente.dicts("semanas") if s["dia_inicio"] == lunes] or [{}]:
                    yield {
                        **f,
                        "origen": origen,
                        "t": t,
                        "valido": valido,
                        "lunes": lunes,
                        "s": s,
                        "v_cant": h["cant"] if origen == "V" else 0,
                        "s_cant": h["cant"] if origen == "S" else 0,
                        "importe": _importe(h) if origen == "V" else Decimal(0),
                    }


def _importe(venta):
    return None if venta["pvp_unit"] is None else venta["cant"] * venta["pvp_unit"]


def redondeo(importe, unidades):
    if importe is None:
        return None
    return float((importe / unidades).quantize(Decimal(1), rounding="ROUND_HALF_UP"))
