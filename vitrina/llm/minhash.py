"""Operator 2: near-duplicate documents by b-bit MinHash.

A document is the set of its distinct shingles of five lower-cased words, or of
all its words if there are fewer. Two documents are linked if the sets share
75 % of their union.

1. Equal sets form a class at once; one member, the least doc_id, stands for it.
2. Each class has 128 minima. Four at a time they name 32 buckets, so a pair at
   the threshold meets in at least one bucket but for 5 in a million, a pair at
   80 % but for 6 in a hundred million. Of each minimum the low 4 bits are packed into a signature.
3. In each bucket every class is compared with one hub (the least class, then
   one chosen by hash); links are confirmed on the full sets and joined to
   components. Few buckets still hold two components then.
4. In those, all pairs between different components are compared, in blocks of
   bounded size: signatures first (equal 4-bit lanes, corrected for chance
   collisions), then the full sets of the pairs that may reach the threshold.

No bucket has a cap, and no task holds more than two blocks of a bucket.

Null and empty texts have no shingles and no links. Rows with the same doc_id
are one document. A row without doc_id has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrina.llm.components import components
from vitrina.llm.shared import Workspace
from vitrina.llm.texts import Texts, blocks, constants, mix, runs_of

WORDS, SHARED_PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 4
#: Pairs whose estimate is below are not looked at further: over 5 standard errors under the threshold.
LEAST_ESTIMATE = 0.53
#: Classes in one block of a bucket.
BLOCK = 400

_N = BANDS * ROWS
_TURN = constants(_N, 2).astype(np.uint32) | np.uint32(1)
_STEP = constants(WORDS, 5)


def shingle_sets(texts: Texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = texts.lowered().words()
    hashes = words.hashes()
    runs = runs_of(hashes, WORDS, _STEP)
    for first, last in zip(words.bounds, words.bounds[1:], strict=False):
        n = last - first
        if n >= WORDS:
            yield np.unique(runs[first : last - WORDS + 1])
        elif n:
            yield mix((hashes[first:last] * _STEP[:n]).sum(keepdims=True) ^ np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least image of the set under each of the 128 maps."""
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(short), 1024):
        np.minimum(out, (short[first : first + 1024, None] * _TURN).min(0), out=out)
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    named = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        named = mix(named ^ rows[:, :, j]) + np.uint64(j)
    return named.view(np.int64)


def _packed(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of a signature to others: lanes without a differing bit, less
    those that agree by chance."""
    differ = np.bitwise_xor(others, one)
    equal = ((differ & 0x0F) == 0).sum(1) + ((differ & 0xF0) == 0).sum(1)
    chance = 2.0**-BITS
    return (equal / _N - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, n (set size), k1 and k2 (a 128-bit name of the set), bands, signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                sets = list(shingle_sets(texts))
                least = np.array([minima(s) for s in sets]).reshape(-1, _N)
                k1 = np.array([mix(s.copy()).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                k2 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index(key)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(k1),
                        pa.array(k2),
                        pa.array(list(_bands(least)), pa.list_(pa.int64())),
                        pa.array([row.tobytes() for row in _packed(least)], pa.binary()),
                    ],
                    ["id", "n", "k1", "k2", "bands", "signature"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, bands array<long>, signature binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """id, n and the full set of each wanted class (its text is that of its id)."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in blocks(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(found)]
                keys = [part.column(part.schema.get_field_index(c)) for c in ("id", "n", "k1")]
                own = pa.array([mix(s.view(np.uint64).copy()).sum() if len(s) else 0 for s in sets], pa.uint64())
                yield pa.RecordBatch.from_arrays(
                    [*keys, own.view(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "k1", "own", "shingles"]
                )

    kind = wanted.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, n long, k1 long, own long, shingles array<long>")
    # Where a doc_id is repeated with other texts, those are other classes.
    return found.where("own = k1").drop("own").dropDuplicates(["id", "k1"]).drop("k1")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    both = pairs.join(right, "b").join(left, "a")
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SHARED_PERCENT) & (
        shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * SHARED_PERCENT
    )
    return both.where(fits).select("a", "b")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold more than one."""
    labelled = members.join(parts, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component")
    )
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("members"))
    return labelled.join(open_.where("c1 != c2").select("bucket", "members"), "bucket")


def _rest_of_buckets(mixed: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join different components of a bucket: all its pairs, in blocks."""
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))
    )
    placed = (
        mixed.join(classes.select("id", "bands", "signature"), "id")
        .join(sets, "id")
        .select("bucket", "id", "component", "n", "bands", "signature", "shingles", own.alias("block"), F.explode(cells).alias("cell"))
        .select("bucket", "cell.i", "cell.j", "id", "component", "n", "bands", "signature", "shingles", "block")
    )
    kind = mixed.schema["id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        block = group.column("block").to_numpy()
        parts = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        signature = np.array([np.frombuffer(s, np.uint8) for s in group.column("signature").to_pylist()])
        lists = group.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        band = int(np.flatnonzero(bands[0] == bucket)[0])
        found = []
        for x in range(len(ids)):
            y = np.arange(x + 1, len(ids))
            y = y[parts[y] != parts[x]]
            if i != j:
                y = y[block[y] != block[x]]
            y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * SHARED_PERCENT]
            if len(y) and band:  # a pair is looked at in its first common bucket only
                y = y[~(bands[y, :band] == bands[x, :band]).any(1)]
            if len(y):
                y = y[estimate(signature[x], signature[y]) >= LEAST_ESTIMATE]
            mine = flat[ends[x] : ends[x + 1]]
            for k in y:
                if parts[k] == parts[x]:
                    continue  # joined by a link found meanwhile
                other = flat[ends[k] : ends[k + 1]]
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                if shared * 100 >= (n[x] + n[k] - shared) * SHARED_PERCENT:
                    found.append((ids[x], ids[k]))
                    parts[parts == parts[k]] = parts[x]
        a, b = zip(*found, strict=True) if found else ((), ())
        types = group.schema.field("id").type
        return pa.table({"a": pa.array(a, types), "b": pa.array(b, types)})

    return placed.groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, `n_shingles`, `component_id` and `kept`."""
    work = Workspace(docs.sparkSession, "minhash")
    rows = work.write(signatures(docs, key, text), "rows")
    full = rows.where("n > 0 and id is not null")
    classes = work.write(
        full.groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    spread = classes.select("id", F.explode("bands").alias("bucket"))
    hubs = work.write(
        spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).where("members > 1").drop("members"), "hubs"
    )
    members = work.write(spread.join(hubs, "bucket"), "members")
    wanted = members.select("id").distinct().join(classes.select("id", "n", "k1"), "id")
    sets = work.write(_full_sets(docs, wanted, key, text), "sets")

    # A document whose rows differ belongs to several classes, and links them to the least.
    named = full.join(classes.select("k1", "k2", F.col("id").alias("class")), ["k1", "k2"]).select("id", "class").distinct()
    torn = named.join(named.groupBy("id").agg(F.min("class").alias("a")), "id").where("a != class").select("a", F.col("class").alias("b"))

    pairs = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = work.write(_confirmed(pairs, sets).unionByName(torn), "links")
    parts = work.write(components(work, links), "parts")

    mixed = _mixed(members.drop("hub"), parts)
    turned = mixed.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id")).alias("hub"))
    pairs = (
        mixed.join(turned, "bucket")
        .where("component != hub.component")
        .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        .distinct()
    )
    links = work.write(links.unionByName(_confirmed(pairs, sets)), "links")
    parts = work.write(components(work, links), "parts")

    mixed = work.write(_mixed(members.drop("hub"), parts), "mixed")
    links = work.write(links.unionByName(_rest_of_buckets(mixed, classes, sets)), "links")
    parts = work.write(components(work, links), "parts")

    by_class = classes.select("k1", "k2", F.col("id").alias("class")).join(parts, F.col("class") == F.col("node"), "left")
    by_class = by_class.select("k1", "k2", F.coalesce("component", "class").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.join(by_class, ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each
    component the document with the least id, and of rows with one id that whose
    text sorts first, a null text last. Rows without an id stay."""
    stay = near_duplicates(docs, key, text).where("kept").select(F.col(key).alias("__stays")).where("__stays is not null").distinct()
    named = docs.where(F.col(key).isNotNull()).join(stay, F.col(key) == F.col("__stays"), "left_semi")
    first = F.row_number().over(W.partitionBy(key).orderBy(F.col(text).asc_nulls_last()))
    single = named.withColumn("__row", first).where("__row = 1").drop("__row")
    return single.unionByName(docs.where(F.col(key).isNull()))
