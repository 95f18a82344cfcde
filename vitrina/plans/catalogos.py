"""Small lookups: weeks, clients, stores, dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expresiones import corte_semanal, lunes, sin_prefijo
from ..operators.intervalos import unir_solapados
from ..params import CLIENTE_DEFECTO
from ..sources.tablas import Fuente
from .contexto import Contexto

POSICION_DESDE = 6  # default range: newest week back to the sixth newest


def clientes(ctx: Contexto) -> DataFrame:
    """Clients with sales, from the summary of the days: no fact is read, and a
    client whose only day is removed goes with it."""
    return ctx.dias("dwh_ventas").select("ini_cliente").distinct()


def cliente_defecto(lista: DataFrame) -> DataFrame:
    """One row: the preferred client if present, else the first by name."""
    cliente = F.col("ini_cliente")
    preferido = F.max(F.when(cliente == CLIENTE_DEFECTO, cliente))
    return lista.agg(F.coalesce(preferido, F.min(cliente)).alias("ini_cliente"))


def tiendas(fuente: Fuente) -> DataFrame:
    return fuente.tabla("tiendas").select(
        "ini_cliente", "n_local", "local", "ciudad", "tipo", "curva", "codigo"
    )


def semanas_disponibles(ctx: Contexto) -> DataFrame:
    """Weeks that overlap the dates with sales, newest first. The two bounds
    are scalar subqueries over the summary of the days; no fact is read."""
    fechas = ctx.dias("dwh_ventas").select("fecha")
    primera = fechas.agg(F.min("fecha")).scalar()
    ultima = fechas.agg(F.max("fecha")).scalar()
    return (
        ctx.semanas()
        .df.where((F.col("dia_fin") >= primera) & (F.col("lunes") <= ultima))
        .select(F.col("semanas").alias("semana_formateada"), F.col("dia_fin").alias("fin_semana"))
        .distinct()
        .orderBy(F.col("fin_semana").desc())
    )


def semanas_por_tienda(ctx: Contexto) -> DataFrame:
    """Weeks that overlap the dates between the first and the last sale of each
    store of a client: the list of ``semanas_disponibles`` for many spans at
    once. The facts are read once, with partial bounds on the map side."""
    tramos = (
        ctx.fuente.tabla("dwh_ventas")
        .groupBy("ini_cliente", "num_local")
        .agg(F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"))
    )
    semanas = ctx.semanas().df.select("lunes", "dia_fin", "semanas").distinct()
    return unir_solapados(tramos, semanas, desde=("primera", "lunes"), hasta=("ultima", "dia_fin")).select(
        "ini_cliente",
        F.col("num_local").alias("c_l"),
        F.col("semanas").alias("semana_formateada"),
        F.col("dia_fin").alias("fin_semana"),
    )


def rango_fechas_defecto(
    semanas: DataFrame,
    as_of: date,
    desde: date | None = None,
    hasta: date | None = None,
) -> DataFrame:
    """One row ``fecha_inicio, fecha_fin``: the chosen week ends in order, by
    default the newest and the sixth newest (or the oldest, if there are fewer);
    without any week the last seven days."""
    ultimas = semanas.orderBy(F.col("fin_semana").desc(), "semana_formateada").limit(POSICION_DESDE)
    bordes = ultimas.agg(
        F.coalesce(F.lit(desde), F.min("fin_semana"), F.lit(as_of - timedelta(weeks=1))).alias("a"),
        F.coalesce(F.lit(hasta), F.max("fin_semana"), F.lit(as_of)).alias("b"),
    )
    return bordes.select(
        F.least("a", "b").alias("fecha_inicio"), F.greatest("a", "b").alias("fecha_fin")
    )


def fechas_corte(df: DataFrame, fecha: Column | str = "fecha") -> DataFrame:
    """For every date: ISO week, cut-off Saturday, and the cut-off 52 weeks
    before (which is not the same day one calendar year before)."""
    dia = F.col(fecha) if isinstance(fecha, str) else fecha
    return df.select(
        dia.alias("fecha"),
        F.weekofyear(dia).alias("semana_iso"),
        corte_semanal(dia).alias("corte_actual"),
        F.date_sub(lunes(dia), 52 * 7 + 2).alias("corte_ano_previo"),
    )


def fechas_corte_de(spark: SparkSession, dia: date | None = None) -> DataFrame:
    """The same for one day, by default today."""
    return fechas_corte(spark.range(1).select(F.lit(dia or date.today()).alias("fecha")))


def lista_tiendas(reporte: DataFrame) -> DataFrame:
    """Stores of a report with their display text, by city and name."""
    return (
        reporte.select("c_l", "ciudad", "local")
        .distinct()
        .withColumn("display", F.concat(sin_prefijo(F.col("ciudad")), F.lit("-"), "local"))
        .orderBy("ciudad", "local")
    )
