"""Shape of the physical plans."""

import re

import pytest
from apoyo import plan

import __spark_entry__ as contrato
from vitrina.plans.contexto import Contexto
from vitrina.sources import FuenteEstrella

DE_HECHOS = (
    "ventas_por_tienda",
    "ventas_por_color",
    "ventas_por_talla",
    "ventas_stock_detalle",
    "ventas_sem_ano",
    "ventas_stock_8sem",
)


def intercambios(texto):
    return re.findall(r"Exchange (hash|range|Single|RoundRobin)\w*", texto)


@pytest.mark.parametrize("clave", DE_HECHOS)
def test_un_solo_intercambio(spark, datos, clave):
    """Facts are shuffled once, after partial aggregation; each is read once."""
    texto = plan(contrato.queries()[clave](spark, datos))
    assert intercambios(texto) == ["hash"]
    assert texto.count("lineitem.parquet") == 2
    assert "SortMergeJoin" not in texto and "NestedLoop" not in texto and "Cartesian" not in texto
    assert "partial_sum" in texto


@pytest.mark.parametrize("clave", DE_HECHOS)
def test_sin_difundir_se_consolida_antes(spark, datos, clave):
    """Without small dimensions the movements are summed per store, item and
    date before they are shuffled for a join."""
    fuente = FuenteEstrella(spark, datos)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = contrato._PLANES[clave](Contexto(fuente, limite_difusion=0), contrato.UMBRAL)
        texto = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in texto and "Broadcast" not in texto
    if clave not in ("ventas_stock_detalle", "ventas_stock_8sem"):
        # Summed again without the item before the join with the few weeks.
        semanas = texto.index("SortMergeJoin [lunes")
        assert "HashAggregate(keys=[num_local" in texto[semanas : texto.index("SortMergeJoin [ean")]
    # The deepest exchange over the facts carries partial sums of the grain.
    union = texto.index("Union")
    antes = texto[:union]
    ultimo = antes[antes.rindex("Exchange hashpartitioning") :]
    assert re.match(r"Exchange hashpartitioning\(num_local#\d+, ean#\d+, fecha#\d+", ultimo)
    assert "partial_sum" in ultimo


def test_no_se_lee_lo_que_no_se_usa(spark, datos):
    texto = plan(contrato.queries()["ventas_por_color"](spark, datos))
    assert "l_extendedprice" not in texto  # colour report has no price
    assert "l_discount" not in texto
    assert "GreaterThanOrEqual(l_shipdate,2001-08-05T00:00)" in texto


@pytest.mark.parametrize("clave", contrato._PLANES)
def test_sin_productos_cruzados(spark, datos, clave):
    texto = contrato.queries()[clave](spark, datos)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in texto and "BroadcastNestedLoopJoin" not in texto
    assert "PythonUDF" not in texto and "ArrowEval" not in texto


def test_exportacion_filtrada_limita_la_lectura(spark, datos):
    """Store and weeks of the selection reach the fact scan."""
    ctx, umbral = contrato._contexto(spark, datos)
    texto = plan(
        contrato.reportes.detalle_filtrado(
            ctx, contrato._ventana(umbral), tienda=contrato.TIENDA, semanas=contrato.SEMANAS
        )
    )
    filtros = "\n".join(re.findall(r"Filter .*l_shipdate.*", texto))
    assert "2001-08-13" in filtros and "2001-08-05" not in filtros
    assert re.search(r"cast\(l_suppkey#\d+L? as string\) = 68\b", filtros)


def test_totales_sin_ventana_global(spark, datos):
    for clave in ("participacion_color", "participacion_talla", "participacion_color_tienda"):
        texto = plan(contrato.queries()[clave](spark, datos))
        for linea in re.findall(r"Exchange SinglePartition.*\n.*", texto):
            assert "HashAggregate(keys=[]" in linea, "only one-row totals meet in one task"
