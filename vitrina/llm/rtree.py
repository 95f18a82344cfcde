"""Operator 12: documents that share 85 % of their four-word shingles, by R-trees over count vectors.

A document is the set of its distinct shingles of four lower-cased words, or of
all its words if there are fewer. Equal sets form a class at once.

1. Shingles are hashed into groups, and a class is the point of its counts per
   group: about one group for four shingles, so a point has as many coordinates
   as its set can tell apart. Two sets share no more than the sum of the smaller
   counts of each group; a coarser point is a finer one with neighbours added.
2. Two sets that share 85 % of their union have a shingle in common among the
   first 15 % (and one) of each, in any order of all shingles. So there is a tree
   for each of these shingles, over the classes that have it there. The order is
   rare ones first: shingles found often in many texts come last, by a list of
   at most `COMMON`, which changes the trees but never a result.
3. Each tree is first compared with its least class; bounds leave few pairs,
   which are confirmed on full sets and joined to components. A tree of two is
   settled by that, and so is one whose classes are all in one component.
4. The rest are searched: boxes of classes of like size hold the greatest count
   of each group. A box whose counts can't share enough with a class is passed
   over; of the others every class is bounded by itself. Only classes of other
   components are asked for. What survives is confirmed on full sets.

Trees are dealt in blocks of `BLOCK` classes, so no task holds more than two
blocks of one. No tree, list or candidate is capped; no link is lost.

Null and empty texts have no shingles and no links. Rows with the same doc_id
are one document. A row without doc_id has no component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.components import components
from vitrina.llm.shared import Workspace
from vitrina.llm.texts import Texts, blocks, constants, mix, runs_of

WORDS, SHARED_PERCENT = 4, 85
#: Shingles known as common, and how often a stretch of texts must hold one to name it.
COMMON, _NAMED = 1 << 15, 4
#: Shingles that are counted together to find common ones.
_STRETCH = 1 << 22
#: Shingles for one group of the count vector, and the fewest and most groups.
PER_GROUP, _LEAST_GROUPS, _MOST_GROUPS = 4, 16, 4096
#: Trees of a class that are told along with it.
_FEW_TREES = 8
#: Classes in one block of a tree, in one leaf, and leaves in one inner box.
BLOCK, LEAF, FAN = 400, 16, 8

_STEP = constants(WORDS, 12)


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


# --- points ------------------------------------------------------------------------


def _groups(n: int) -> int:
    return min(max(1 << max(0, (n - 1) // PER_GROUP).bit_length(), _LEAST_GROUPS), _MOST_GROUPS)


def counts(shingles: np.ndarray) -> bytes:
    """The set's count of each group; a group is the shingles with the same first bits."""
    groups = _groups(len(shingles))
    found = np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return found.astype(_width(len(shingles))).tobytes()


def _width(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.uint32


def vector(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, _width(n)).astype(np.int64)


def coarser(vectors: np.ndarray, groups: int) -> np.ndarray:
    """The same points with only so many groups."""
    return vectors.reshape(*vectors.shape[:-1], groups, -1).sum(-1)


def may_link(shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return (100 + SHARED_PERCENT) * shared >= SHARED_PERCENT * (n_a + n_b)


def like_sizes(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * SHARED_PERCENT


class Tree:
    """Boxes over points: the greatest count of each group, the least and greatest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # Slabs by size; inside a slab by the group that varies most.
        order = np.argsort(sizes, kind="stable")
        for first in range(0, len(order), LEAF * FAN):
            slab = order[first : first + LEAF * FAN]
            widest = int(np.argmax(np.ptp(points[slab], axis=0)))
            order[first : first + LEAF * FAN] = slab[np.argsort(points[slab, widest], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        most, low, high = self.points, self.sizes, self.sizes
        for fan in (LEAF, FAN):
            at = np.arange(0, len(low), fan)
            most, low, high = np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((fan, most, low, high))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """The points that may share enough with this one."""
        boxes = np.arange(len(self.levels[-1][1]))
        least = -(-SHARED_PERCENT * size // 100)
        for depth in (1, 0):
            fan, most, low, high = self.levels[depth]
            fits = (high[boxes] >= least) & (low[boxes] * SHARED_PERCENT <= size * 100)
            boxes = boxes[fits]
            shared = np.minimum(most[boxes], point).sum(1)
            boxes = boxes[may_link(shared, size, np.maximum(low[boxes], least))]
            below = len(self.levels[0][1]) if depth else len(self.sizes)
            boxes = (boxes[:, None] * fan + np.arange(fan)).ravel()
            boxes = boxes[boxes < below]
        boxes = boxes[like_sizes(self.sizes[boxes], size)]
        shared = np.minimum(self.points[boxes], point).sum(1)
        return self.order[boxes[may_link(shared, size, self.sizes[boxes])]]


def candidates(vectors: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each point, those of the points that may share enough with it; pairs
    come up at least once. Points of like size have equal or neighbouring numbers
    of groups, so one tree holds those of a number and, made coarser, of the next."""
    groups = np.array([len(v) for v in vectors])
    for g in np.unique(groups):
        near = np.flatnonzero((groups == g) | (groups == 2 * g))
        points = np.array([coarser(vectors[i], g) for i in near])
        tree = Tree(points, sizes[near])
        for x in np.flatnonzero(groups[near] == g):
            found = tree.search(points[x], int(sizes[near[x]]))
            found = found[(found > x) | (groups[near[found]] != g)]
            if len(found):
                yield near[x], near[found]


# --- tables -------------------------------------------------------------------------


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """The shingles found most often, sorted by hash, with the place in the order of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for _, texts in blocks(batch, text):
                for s in shingle_sets(texts):
                    held.append(s)
                    total += len(s)
                    if total >= _STRETCH:
                        yield _often(held)
                        held, total = [], 0
        if held:
            yield _often(held)

    found = docs.select(text).mapInArrow(run, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    top = found.orderBy(F.col("docs").desc(), "shingle").limit(COMMON).collect()
    table = np.array([(r.shingle, i) for i, r in enumerate(reversed(top))], np.int64).reshape(-1, 2)
    return table[np.argsort(table[:, 0].view(np.uint64))]


def _often(sets: list[np.ndarray]) -> pa.RecordBatch:
    values, found = np.unique(np.concatenate(sets), return_counts=True)
    often = found >= _NAMED
    return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(found[often])], ["shingle", "docs"])


def first_shingles(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first 15 % and one of the set: rare ones by hash, then common ones, the most common last."""
    wanted = len(shingles) - -(-SHARED_PERCENT * len(shingles) // 100) + 1 if len(shingles) else 0
    if not len(common):
        return shingles[:wanted]
    names = common[:, 0].view(np.uint64)
    at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
    known = names[at] == shingles
    rare = shingles[~known]
    if len(rare) >= wanted:
        return rare[:wanted]
    often = shingles[known][np.argsort(common[at[known], 1])]
    return np.concatenate([rare, often[: wanted - len(rare)]])


def _points(docs: DataFrame, key: str, text: str, common: np.ndarray) -> DataFrame:
    """Per row: id, n (set size), k1 and k2 (a 128-bit name of the set), first shingles, counts."""
    order = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                sets = list(shingle_sets(texts))
                k1, k2 = _names(sets)
                firsts = [first_shingles(s, order.value).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index(key)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        k1,
                        k2,
                        pa.array(firsts, pa.list_(pa.int64())),
                        pa.array([counts(s) for s in sets], pa.binary()),
                    ],
                    ["id", "n", "k1", "k2", "firsts", "counts"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, firsts array<long>, counts binary")


def _names(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    one = np.array([mix(s.copy()).sum() if len(s) else 0 for s in sets], np.uint64)
    two = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
    return pa.array(one.view(np.int64)), pa.array(two.view(np.int64))


def _like(n_a: str, n_b: str) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SHARED_PERCENT


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose count vectors leave room for a link."""
    points = classes.select("id", "n", "counts")
    sides = [points.select(*[F.col(c).alias(f"{c}_{x}") for c in points.columns]) for x in "ab"]
    both = pairs.join(sides[0], F.col("a") == F.col("id_a")).join(sides[1], F.col("b") == F.col("id_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            n_a, n_b = (rows.column(c).to_numpy() for c in ("n_a", "n_b"))
            left, right = (rows.column(c).to_pylist() for c in ("counts_a", "counts_b"))
            keep = np.zeros(len(n_a), bool)
            for i in np.flatnonzero(like_sizes(n_a, n_b)):
                x, y = vector(left[i], n_a[i]), vector(right[i], n_b[i])
                g = min(len(x), len(y))
                keep[i] = may_link(np.minimum(coarser(x, g), coarser(y, g)).sum(), n_a[i], n_b[i])
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _confirmed(work: Workspace, pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets share enough."""
    pairs = work.write(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = ids.join(classes.select("id", "k1", "k2"), "id")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(wanted, "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in blocks(batch, "text"):
                sets = list(shingle_sets(found))
                k1, k2 = _names(sets)
                own = np.flatnonzero((k1.to_numpy() == part.column(2).to_numpy()) & (k2.to_numpy() == part.column(3).to_numpy()))
                keep = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(keep), k1.take(keep), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))],
                    ["id", "k1", "shingles"],
                )

    kind = classes.schema["id"].dataType.simpleString()
    sets = texts.select("id", "text", "k1", "k2").mapInArrow(run, f"id {kind}, k1 long, shingles array<long>")
    # Rows with one doc_id and one set are read once.
    sets = work.write(sets.dropDuplicates(["id", "k1"]).drop("k1"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b"))
    shared, total = F.size(F.array_intersect("s_a", "s_b")).cast("long"), (F.size("s_a") + F.size("s_b")).cast("long")
    linked = pairs.join(right, "b").join(left, "a").where(shared * (100 + SHARED_PERCENT) >= total * SHARED_PERCENT)
    links = work.write(linked.select("a", "b"), "confirmed")
    work.drop(sets, pairs)
    return links


def _open_trees(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their component, of trees of over two classes, that have a
    class of like size and of another component in their tree."""
    # Like sizes differ by one box at most.
    box = F.floor(F.log("n") / F.log(F.lit(100 / (SHARED_PERCENT - 1)))).cast("int")
    labelled = (
        members.where("members > 2")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select("tree", "id", "n", "hub", F.coalesce("component", "id").alias("component"), box.alias("box"))
    )
    held = labelled.groupBy("tree", "box").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    near = held.select("tree", F.explode(F.array(*[F.col("box") + d for d in (-1, 0, 1)])).alias("box"), "c1", "c2")
    mixed = near.groupBy("tree", "box").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 != c2")
    return labelled.join(mixed, ["tree", "box"], "left_semi").drop("box")


def _searched(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of one tree, but of two components, that may be
    linked. A pair is left out where one is the least of its tree, as that was
    compared with all others, and where the `_FEW_TREES` least names of both
    their trees show an earlier tree that holds both; so it never is in the
    first of their trees."""
    sizes = open_.groupBy("tree").agg(F.count(F.lit(1)).alias("members"))
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), count).cast("int")
    cells = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    columns = ["id", "component", "n", "counts", "few"]
    few = F.slice(F.sort_array("firsts"), 1, _FEW_TREES).alias("few")
    placed = (
        open_.join(sizes, "tree")
        .join(classes.select("id", "n", "counts", few), ["id", "n"])
        .select("tree", *columns, (F.col("id") == F.col("hub")).alias("least"), own.alias("block"), F.explode(cells).alias("cell"))
        .select("tree", "cell.i", "cell.j", *columns, "least", "block")
    )
    cell = ["tree", "i", "j"]

    def pairs(rows: pa.Table, bounds: np.ndarray) -> pa.Table:
        """rows holds whole cells, from each bound to the next."""
        tree, i, j, sizes, block, least = (rows.column(c).to_numpy() for c in (*cell, "n", "block", "least"))
        codes = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        data, few = rows.column("counts"), rows.column("few").combine_chunks()
        names, ends = few.flatten().to_numpy(), np.concatenate([[0], np.cumsum(few.value_lengths().to_numpy())])
        left, right = [], []
        for first, last in zip(bounds, bounds[1:], strict=False):
            part, n = codes[first:last], sizes[first:last]
            if last - first <= LEAF:  # one leaf: is there anything to compare?
                apart = part[:, None] != part
                if not (apart & like_sizes(n[:, None], n)).any():
                    continue
            vectors = [vector(d, k) for d, k in zip(data[first:last].to_pylist(), n, strict=True)]
            for x, found in candidates(vectors, n):
                other = (part[found] != part[x]) & ~(least[first + found] | least[first + x])
                if i[first] != j[first]:
                    other &= block[first + found] != block[first + x]
                for y in found[other]:
                    common = np.intersect1d(*(names[ends[k] : ends[k + 1]] for k in (first + x, first + y)), assume_unique=True)
                    if not len(common) or common[0] >= tree[first]:
                        left.append(first + x)
                        right.append(first + y)
        ids = rows.column("id")
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            cells = np.array([rows.column(c).to_numpy() for c in cell])
            bounds = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(0)])) if rows.num_rows else np.zeros(1, np.int64)
            yield from pairs(rows, bounds).to_batches()
            rest = rows.slice(bounds[-1])
        if rest is not None and rest.num_rows:
            yield from pairs(rest, np.array([0, rest.num_rows])).to_batches()

    kind = open_.schema["id"].dataType.simpleString()
    dealt = placed.repartition(*cell).sortWithinPartitions(*cell)
    found = dealt.mapInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, `n_shingles` and `component_id`, the least key reachable by links."""
    work = Workspace(docs.sparkSession, "rtree")
    rows = work.write(_points(docs, key, text, _common(docs, text)), "rows")
    full = rows.where("n > 0 and id is not null")
    classes = work.write(
        full.groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("firsts").alias("firsts"), F.first("counts").alias("counts")
        ),
        "classes",
    )
    spread = classes.select("id", "n", F.explode("firsts").alias("tree"))
    trees = spread.groupBy("tree").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub"), F.min_by("n", "id").alias("n_hub"))
    members = work.write(spread.join(trees.where("members > 1"), "tree"), "members")

    # A document whose rows differ belongs to several classes, and links them to the least.
    named = full.join(classes.select("k1", "k2", F.col("id").alias("class")), ["k1", "k2"]).select("id", "class").distinct()
    torn = named.join(named.groupBy("id").agg(F.min("class").alias("a")), "id").where("a != class").select("a", F.col("class").alias("b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return _confirmed(work, pairs, docs, classes, key, text)

    first = members.where("id != hub").where(_like("n", "n_hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = work.write(confirmed(_bounded(first, classes)).unionByName(torn), "links")
    parts = work.write(components(work, links), "parts")

    open_ = work.write(_open_trees(members, parts), "open")
    work.drop(members)
    links = work.write(links.unionByName(confirmed(_searched(open_, classes))), "links")
    work.drop(open_)
    parts = work.write(components(work, links), "parts")

    by_class = classes.select("k1", "k2", F.col("id").alias("class")).join(parts, F.col("class") == F.col("node"), "left")
    by_class = by_class.select("k1", "k2", F.coalesce("component", "class").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.join(by_class, ["k1", "k2"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
