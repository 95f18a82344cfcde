"""Schemas of the two fact tables and the eight dimension tables.

Dimension keys are *not* declared unique: a repeated key fans a fact row out,
and every plan in this package keeps that behaviour.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _tabla(**columnas: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columnas.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DateType()
PRECIO = T.DecimalType(12, 2)

ESQUEMAS: dict[str, T.StructType] = {
    "dwh_ventas": _tabla(
        ini_cliente=_S, num_local=_S, ean=_S, fecha=_D, cant=_I, pvp_unit=PRECIO
    ),
    "dwh_stock": _tabla(ini_cliente=_S, num_local=_S, ean=_S, fecha=_D, cant=_I),
    "cat_sku": _tabla(
        ean=_S,
        sku=_S,
        ref_modelo=_S,
        marca=_S,
        categoria=_S,
        cod_color=_S,
        talla=_S,
        descripcion_nueva=_S,
    ),
    "tiendas": _tabla(
        ini_cliente=_S, n_local=_I, local=_S, ciudad=_S, tipo=_S, curva=_S, codigo=_S
    ),
    "monitoreo": _tabla(modelo=_S, marca=_S, tipo=_S, fit=_S),
    "marca": _tabla(marca_bd=_S, new_marca=_S),
    "marca_subclase": _tabla(ini_cliente=_S, subcategoria=_S, marca=_S),
    "cod_color": _tabla(codigo=_S, color=_S, color_hexa=_S),
    "ecat_fala": _tabla(upc=_S, sku_madre=_S),
    "semanas": _tabla(dia_inicio=_D, dia_fin=_D, n_sem=_I, ano=_I),
}

HECHOS = ("dwh_ventas", "dwh_stock")
