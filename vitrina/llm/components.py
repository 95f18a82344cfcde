"""Distributed union-find: connected components by alternating stars.

Every round links each node to the least node of its neighbourhood, first the
larger neighbours, then the smaller ones, until nothing changes; the result is
one star for each component with its least node in the middle. Only DataFrame
functions are used, each round's links are a written table, and nothing but a
count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import Workspace


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """links: columns a and b, any orderable type. Returns (node, component) of
    every linked node; component is its least reachable node."""
    pairs = links.where("a is not null and b is not null and a != b")
    now = work.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.write(large, "large")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.write(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = _state(after)
        work.drop(now, large)
        now, done = after, state == before
        before = state
        if done:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
