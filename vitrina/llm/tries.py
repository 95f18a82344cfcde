"""Operator 11: the prefix trie of conversations, rolled up in depth bands.

Every distinct sequence of first turns (role, text) is a node; a conversation is
a member of each node on its path. Subtree figures would need a round for each
depth, or a row for each pair of node and ancestor. Here they need neither:

1. Turns get their place in a conversation from one range sort of all rows, so a
   conversation of any length is spread over tasks. A node is named by its depth
   and a 128-bit exclusive or of the hashes of its turns, each with its place,
   which running windows over blocks of a conversation give.
2. Depths are cut in bands of `BAND`. A node sends its figures to its ancestors
   within its band only (at most `BAND` rows), which completes the sums inside
   the band.
3. The first nodes of the bands form a trie of their own, `BAND` times as
   shallow, with those sums as figures. The same roll-up completes it; then each
   completed total goes once to the ancestors in the band above. There are as
   many rounds as a logarithm of the depth to the base `BAND`.

Turns are ordered by `turn` (null first), those with one turn number by role and
text, in byte order; repeated rows are turns of their own. Null role or text
counts as empty. Rows without conv_id belong to no conversation. A table without
conversations has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrina.llm.shared import Workspace

#: Depths in a band; a node has rows for so many ancestors at most.
BAND = 16
#: Turns of a conversation that one window frame runs over.
BLOCK = 1024
#: Conversations share the beginning of the first of so many ids.
FAMILY = 100
#: The shared beginning has fewer turns than this.
HEADS = 6
#: Ids that differ in so many low bits only are joined to one stretch of a node's list.
STRETCH_BITS = 12
#: Characters of a text that decide which task sorts it.
_HEAD = 32

_KEY = ["depth", "s1", "s2"]
_FIGURES = ["n_leaves", "saved_tokens"]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each turn's place, hash and length, and the number of turns of each conversation.

    Rows are sorted by conversation and turn over all tasks. A conversation that
    spans several tasks adds up what the tasks before hold of it.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("c", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, _HEAD))
    placed = dealt.sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "text").select(
        "c",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.length("text").cast("long").alias("chars"),
    )
    placed = work.write(placed, "placed")
    spans = placed.groupBy("c", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    spans = work.write(spans, "spans")
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = spans.select("c", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    turns = placed.join(offsets, ["c", "part"]).select("c", (F.col("at") + F.col("shift")).alias("pos"), "a", "b", "chars")
    turns = work.write(turns, "turns")
    work.drop(placed)
    return turns, spans.groupBy("c").agg(F.sum("rows").alias("total"))


def rebuilt(turns: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, depth, a, b, chars, last) of the rebuilt conversations, and those without any turn (c)."""
    c = F.col("c")
    family = totals.select(c.alias("base"), F.col("total").alias("base_total"))
    plans = (
        totals.withColumn("h", F.crc32(c.cast("string").cast("binary")) % HEADS)
        .withColumn("base", c - c % FAMILY)
        .join(family, "base", "left")
        .withColumn("k", F.least("h", F.coalesce("base_total", F.lit(0))))
        .withColumn("size", F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
        .select("c", "base", "h", "k", "size")
    )
    first = turns.where(F.col("pos") < HEADS).withColumnRenamed("c", "base")
    heads = first.join(plans, "base").where("pos <= h").withColumn("depth", F.col("pos"))
    tails = turns.join(plans, "c").where("pos > h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    columns = ["c", "depth", "a", "b", "chars", (F.col("depth") == F.col("size")).alias("last")]
    return heads.select(*columns).unionByName(tails.select(*columns)), plans.where("size = 0").select("c")


def _steps(turns: DataFrame) -> DataFrame:
    """The turns with the names of their node (s1, s2) and of its parent (p1, p2)."""
    own = turns.withColumns(
        {
            "block": F.expr(f"(depth - 1) div {BLOCK}"),
            "x1": F.xxhash64(F.lit(3), "depth", "a", "b"),
            "x2": F.xxhash64(F.lit(4), "depth", "b", "a"),
        }
    )
    sums = own.groupBy("c", "block").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("c", "block", *[F.coalesce(F.bit_xor(f"y{i}").over(before), F.lit(0)).alias(f"z{i}") for i in (1, 2)])
    upto = W.partitionBy("c", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = own.join(starts, ["c", "block"]).withColumns(
        {f"s{i}": F.bit_xor(f"x{i}").over(upto).bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)}
    )
    parents = [F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return named.select("c", *_KEY, *parents, "chars", "last")


def _root(ids: DataFrame) -> DataFrame:
    """Every conversation as a member of the root."""
    return ids.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"))


def _ways_up(members: DataFrame, unit: int) -> DataFrame:
    """For each node whose depth is a multiple of `unit`: `up`, its ancestors
    within its band and itself. For the first node of a band also a row with
    `below` set, whose `up` is the band above."""
    level = F.expr(f"depth div {unit}")
    here = members.where(F.col("depth") % unit == 0).select("c", level.alias("level"), F.struct("depth", "s1", "s2").alias("node"))
    band = F.expr(f"level div {BAND}")
    inside = here.select("c", band.alias("band"), "node")
    first = here.where(F.col("level") % BAND == 0).where("level > 0").select("c", (band - 1).alias("band"), "node")
    paths = inside.unionByName(first).groupBy("c", "band").agg(F.sort_array(F.collect_list("node")).alias("path"))
    below = F.col("at") == BAND
    ways = paths.select("path", F.posexplode("path").alias("at", "node")).select(
        "node.*", below.alias("below"), F.slice("path", 1, F.least(F.col("at") + 1, F.lit(BAND))).alias("up")
    )
    return ways.groupBy(*_KEY, "below").agg(F.first("up").alias("up"))


def _sent_up(ways: DataFrame, figures: DataFrame) -> DataFrame:
    sent = ways.join(figures, _KEY).select(F.explode("up").alias("node"), *_FIGURES)
    return sent.select("node.*", *_FIGURES)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _FIGURES])


def rolled_up(work: Workspace, members: DataFrame, figures: DataFrame, deepest: int, unit: int = 1) -> DataFrame:
    """The sums of the figures over each node's subtree, for nodes at multiples of `unit`."""
    ways = work.write(_ways_up(members, unit), "ways")
    inside = work.write(_summed(_sent_up(ways.where("not below"), figures)), "inside")
    wider = unit * BAND
    if deepest < wider:
        work.drop(ways)
        return inside
    tops = inside.where(F.col("depth") % wider == 0)
    completed = rolled_up(work, members.where(F.col("depth") % wider == 0), tops, deepest, wider)
    across = _sent_up(ways.where("below"), completed)
    totals = work.write(_summed(inside.unionByName(across)), "totals")
    work.drop(ways, inside, completed)
    return totals


def _digests(ends: DataFrame, work: Workspace) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at each node.

    Ids are joined in stretches first, so that the task that hashes a node's list
    in order reads a row for a stretch of 4096 possible ids, one after the other.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    stretches = ends.groupBy(*_KEY, F.shiftright("c", STRETCH_BITS).alias("stretch")).agg(ids.alias("ids"))
    stretches = work.write(stretches, "stretches")
    found = stretches.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("stretches"), F.first("ids").alias("ids"))
    short = found.where("stretches = 1").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in _KEY)
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["ids"].encode())
            yield _digest_rows(done)
        if node is not None:
            yield _digest_rows([(*node, digest.hexdigest())])

    long = stretches.join(found.where("stretches > 1").select(*_KEY), _KEY)
    ordered = long.repartition(*_KEY).sortWithinPartitions(*_KEY, "stretch").select(*_KEY, "ids")
    return short.unionByName(ordered.mapInArrow(run, "depth long, s1 long, s2 long, ends_sha256 string"))


def _digest_rows(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_KEY, "ends_sha256"])


def _null_long() -> Column:
    return F.lit(None).cast("long")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    work = Workspace(conversations.sparkSession, "trie")
    placed, totals = _turns(conversations, work)
    turns, silent = rebuilt(placed, totals)
    steps = work.write(_steps(turns), "steps")
    work.drop(placed)
    members = steps.select("c", *_KEY).unionByName(_root(totals.select("c")))

    nodes = steps.groupBy(*_KEY).agg(
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.first(c).alias(c) for c in ("p1", "p2", "chars")],
    )
    root = _root(totals.select("c")).groupBy(*_KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = root.select("*", _null_long().alias("p1"), _null_long().alias("p2"), F.lit(0).cast("long").alias("chars"))
    nodes = work.write(nodes.unionByName(root), "nodes")

    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    childless, nodes = nodes, work.write(nodes.join(children, _KEY, "left").fillna(0, ["n_children"]), "with-children")
    work.drop(childless)

    figures = nodes.select(
        *_KEY, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(work, members, figures, deepest)

    digests = _digests(steps.where("last").select("c", *_KEY).unionByName(_root(silent)), work)
    work.drop(steps)
    above = nodes.select(F.col("depth").alias("d"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    above = above.withColumn("depth", F.col("d") + 1).drop("d")
    return (
        nodes.join(sums, _KEY)
        .join(digests, _KEY, "left")
        .join(above, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
        )
    )
