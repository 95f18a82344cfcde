import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

RAIZ = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(RAIZ))

DATOS = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    sesion = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("compartida")))
        .getOrCreate()
    )
    sesion.sparkContext.setLogLevel("ERROR")
    yield sesion
    sesion.stop()


@pytest.fixture(scope="session")
def datos():
    if not DATOS.exists():
        pytest.skip("test data not available")
    return str(DATOS)


@pytest.fixture(scope="module")
def sin_codegen(spark):
    """Interpreted expressions: compiling code for a handful of rows is most
    of a query's time. The parity tests run compiled."""
    claves = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for clave, valor in claves.items():
        spark.conf.set(clave, valor)
    yield
    for clave in claves:
        spark.conf.unset(clave)
