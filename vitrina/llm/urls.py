"""Operator 5: URL filters by a sort-merge range join.

A rule of a host and a path prefix becomes the key `com.example./en/`: the
host's labels reversed, then the path. The keys that begin with a rule's key
are an interval, and such intervals nest or are disjoint. A url gives one probe
for each host that could hold a rule (its own and its parents). Rules and
probes are sorted together over range partitions; going through them, the
stack of rules open at a probe is that of the last rule before it, and the
longest of them that the probe begins with is the one that fits.

Only DataFrame functions are used. A hot host is spread by its paths, since
partitions are ranges of whole keys; equal urls are judged once.

Null urls and urls without `://` have an empty host and path. Of rules that
are equal, the verdict that sorts first holds; of fitting rules the longest
(host and path together), then the one with the longer host wins. With no rule
the verdict is `default`. One row is returned for each row of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vitrina.llm.shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.concat(F.concat_ws(".", labels), F.lit("."))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Each distinct rule's key and `open`: the rules whose intervals hold it,
    itself included, the longest first."""
    one = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keyed = one.select(
        F.concat(_reversed(F.reverse(F.split("host", r"\."))), "path").alias("key"),
        F.struct(
            F.concat(_reversed(F.reverse(F.split("host", r"\."))), "path").alias("key"),
            F.length("host").alias("host_length"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("rule"),
    ).groupBy("key").agg(F.min("rule").alias("rule"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))
    outer = keyed.withColumnsRenamed({"key": "outer_key", "rule": "outer"})
    return (
        keyed.select("key", F.explode(prefixes).alias("outer_key"))
        .join(outer, "outer_key")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("outer_key").alias("n"), "outer")), asc=False).alias("open"))
        .select("key", F.transform("open", lambda x: x["outer"]).alias("open"))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of pages with `host`, `path`, `rule` (null if none fits) and `verdict`
    in the place of columns of those names."""
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    host, path = host_and_path(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    compiled = compile_rules(rules)
    labels = F.size(F.split("host", r"\."))
    most = rules.agg(F.max(labels)).first()[0] or 0  # no rule reaches deeper than this

    backwards = F.reverse(F.split("host", r"\."))
    depths = F.sequence(F.lit(1), F.least(labels, F.lit(max(most, 1))))
    probes = (
        split.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.transform(depths, lambda n: _reversed(F.slice(backwards, 1, n)))).alias("key"))
        .select(F.concat("key", "path").alias("key"), "host", "path", F.lit(1).alias("kind"))
    )
    starts = compiled.select("key", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("kind"), "open")
    events = starts.unionByName(probes.withColumn("open", F.lit(None).cast(starts.schema["open"].dataType)))

    # Ranges of whole keys; the written table fixes which key is in which.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = work.write(
        events.repartitionByRange(parts, "key", "kind", "host", "path").withColumn("part", F.spark_partition_id()), "ranges"
    )
    # The stack that a range begins with is that of the last rule before it.
    last = ranged.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, F.col("key"))).alias("last_key"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    entering = (
        last.select("part", F.last("last_key", ignorenulls=True).over(before).alias("key"))
        .join(compiled.withColumnRenamed("open", "entering"), "key")
        .select("part", "entering")
    )
    inside = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = (
        ranged.withColumn("stack", F.last("open", ignorenulls=True).over(inside))
        .where("kind = 1")
        .join(F.broadcast(entering), "part", "left")  # at most one row for each range
        .withColumn("stack", F.coalesce("stack", "entering"))
    )
    fitting = F.filter("stack", lambda r: F.col("key").startswith(r["key"]))
    found = (
        swept.select("host", "path", F.get(fitting, F.lit(0)).alias("r"))
        .where("r is not null")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("r.rule").alias("n"), F.col("r.host_length").alias("h"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")
                )
            ).alias("__rule")
        )
    )
    kept = [c for c in split.columns if c not in ("rule", "verdict")]
    return split.select(*kept).join(found, ["host", "path"], "left").select(
        *kept, F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", F.lit(default)).alias("verdict")
    )


RULE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
