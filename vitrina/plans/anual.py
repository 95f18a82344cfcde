"""Weeks side by side with the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expresiones import crecimiento_pct, nombre_dia
from ..operators.filtros import TODOS, filtros_dinamicos, predicado

# Weekday columns of the pivot, Monday first.
COLUMNAS_DIA = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")


def filtrar_anual(
    diario: DataFrame, cliente: str = TODOS, marca: str = TODOS, programa: str = TODOS
) -> DataFrame:
    """Cascaded client, brand and programme choice; "Todos" leaves it open."""
    return filtros_dinamicos(
        diario, {"ini_cliente": cliente, "marca": marca, "tipo_programa": programa}
    )


def opciones_cascada(diario: DataFrame, cliente: str = TODOS, marca: str = TODOS) -> DataFrame:
    """The option lists of client, brand and programme, each over the rows that
    the choices before it leave, from one pass: ``filtro``, ``opcion`` and how
    many rows have it. Unknown values are no option."""
    elegido = {"ini_cliente": cliente, "marca": marca}
    columnas = ("ini_cliente", "marca", "tipo_programa")
    ofertas, quedan = [], F.lit(True)
    for columna in columnas:
        opcion = F.when(quedan, F.col(columna).cast("string"))
        ofertas.append(F.struct(F.lit(columna).alias("filtro"), opcion.alias("opcion")))
        quedan = quedan & predicado({columna: elegido.get(columna, TODOS)})
    lista = F.filter(F.array(*ofertas), lambda oferta: oferta["opcion"].isNotNull())
    return (
        diario.groupBy(*columnas)
        .agg(F.count(F.lit(1)).alias("filas"))
        .select(F.inline(lista), "filas")
        .groupBy("filtro", "opcion")
        .agg(F.sum("filas").alias("filas"))
        .orderBy("filtro", "opcion")
    )


def con_dia(diario: DataFrame) -> DataFrame:
    return diario.withColumn("dia_es", nombre_dia(F.col("fecha")))


def pivote_semana_ano(diario: DataFrame) -> DataFrame:
    """One row per week and year: sales of each weekday, their total, and the
    stock on the first and last date that has any row.

    Days are summed first (partially on the map side), so the second step sees
    at most seven rows per week and year, however large one of them is.
    """
    dias = (
        diario.dropna(subset=["n_sem", "ano"])
        .groupBy("n_sem", "ano", "fecha")
        .agg(F.sum("cant_venta").alias("venta"), F.sum("cant_stock").alias("stock"))
    )
    ventas_dia = [
        F.sum(F.when(F.weekday("fecha") == i, F.col("venta")).otherwise(0)).alias(dia)
        for i, dia in enumerate(COLUMNAS_DIA)
    ]
    return (
        dias.groupBy("n_sem", "ano")
        .agg(
            F.min_by("stock", "fecha").alias("stock_inicial"),
            *ventas_dia,
            F.max_by("stock", "fecha").alias("stock_final"),
            F.sum("venta").alias("venta_total"),
        )
        .orderBy(F.col("n_sem").desc(), "ano")
    )


def crecimiento_anual(pivote: DataFrame) -> DataFrame:
    """Growth of each week's sales between its two latest years; weeks seen in
    one year only have none."""
    por_ano = Window.partitionBy("n_sem").orderBy("ano")
    desde_ultimo = Window.partitionBy("n_sem").orderBy(F.col("ano").desc())
    return (
        pivote.select(
            "n_sem",
            F.col("ano").alias("ano_actual"),
            F.lag("ano").over(por_ano).alias("ano_anterior"),
            F.col("venta_total").alias("venta_actual"),
            F.lag("venta_total").over(por_ano).alias("venta_anterior"),
            F.row_number().over(desde_ultimo).alias("desde_ultimo"),
        )
        .where((F.col("desde_ultimo") == 1) & F.col("ano_anterior").isNotNull())
        .drop("desde_ultimo")
        .withColumn("crecimiento_pct", crecimiento_pct(F.col("venta_actual"), F.col("venta_anterior")))
    )
