"""Every registered query against the SQL oracle on whole tables."""

import duckdb
import pytest
from apoyo import filas, normal, ordenadas

import __spark_entry__ as contrato
from vitrina.plans.contexto import Contexto
from vitrina.sources import FuenteEstrella

ORACULO = contrato.oracle_sql()
CONSULTAS = {clave: q for clave, q in contrato.queries().items() if clave in contrato._PLANES}


@pytest.fixture(scope="module")
def duck(datos):
    from pathlib import Path

    con = duckdb.connect()
    for archivo in Path(datos).glob("*.parquet"):
        con.sql(f"create view {archivo.stem} as select * from '{archivo}'")
    return con


def esperado(duck, clave):
    rel = duck.sql(ORACULO[clave])
    orden = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), ordenadas(tuple(normal(f[i]) for i in orden) for f in rel.fetchall())


def test_cada_consulta_tiene_oraculo():
    assert set(CONSULTAS) <= set(ORACULO)


@pytest.mark.parametrize("clave", CONSULTAS)
def test_consulta(spark, datos, duck, clave):
    df = CONSULTAS[clave](spark, datos)
    columnas, filas_sql = esperado(duck, clave)
    assert sorted(df.columns) == columnas
    assert filas(df) == filas_sql


# Reports over the facts again with nothing small enough to broadcast: facts
# are consolidated first and joined without hints.
DE_HECHOS = [
    "ventas_por_tienda",
    "ventas_por_tienda_rp",
    "ventas_por_tienda_sin_calendario",
    "ventas_por_color",
    "ventas_por_talla",
    "ventas_stock_detalle",
    "ventas_stock_detalle_rp",
    "ventas_sem_ano",
    "ventas_stock_8sem",
    "grupos_validos",
    "union_null_safe_grupos",
    "participacion_talla_tienda",
]


@pytest.fixture(scope="module")
def ctx_sin_difusion(spark, datos):
    fuente = FuenteEstrella(spark, datos)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Contexto(fuente, limite_difusion=0), contrato.UMBRAL
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("clave", DE_HECHOS)
def test_sin_difusion(ctx_sin_difusion, duck, clave):
    df = contrato._comparable(contrato._PLANES[clave](*ctx_sin_difusion))
    assert filas(df) == esperado(duck, clave)[1]
    texto = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in texto


def test_entrada(spark, datos):
    df = contrato.entry(spark)
    assert df.count() == 25
