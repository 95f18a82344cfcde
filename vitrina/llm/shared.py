"""Tables in the shared folder that the cluster names in `spark.checkpoint.dir`.

A result that several later steps read is written there once, so that a lost
executor costs no more than the tasks it was running. Where the setting is
missing, as in tests, a folder below the warehouse is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    place = spark.conf.get(_SETTING, None)
    if not place:
        place = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return place.rstrip("/")


class Workspace:
    """The written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str, settings: dict[str, str] | None = None) -> None:
        """settings: what Spark is set to while a table is written."""
        self.spark = spark
        self.settings = {_CLEAN: "true"} | (settings or {})
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read again; its lineage ends here. Shuffle
        files of the write are of no use afterwards, so Spark may delete them."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with _set(self.spark, self.settings):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        paths = {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles() if f"/{self.root.rsplit('/', 1)[1]}/" in f}
        for path in paths:
            _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
