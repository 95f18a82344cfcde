"""Operator 1: benchmark decontamination by rare n-gram seeds and alignment.

Words are runs of letters and digits in lower case, so case and punctuation do
not matter. Every three neighbouring words of a test item are a seed. A rare
seed that occurs in a document places the item there. Common speech, seeds found
in more than a thousandth of all documents and in more than 20 times the lower
quartile of those of the item's seeds that occur at all, places an item only
together: two seeds from different places of the item in one stretch. No seed is
dropped, so a copy is found in any number of documents, edited or not, unless a
single seed of it is intact and this one is common. The words around the seeds
are aligned to the item by Smith-Waterman, a match counting 1, a replaced,
missing or added word -0.5. The best score over the item's length is the result:
1 for a copy, about 1 - 1.5 p if a share p of the words was replaced.

The benchmark is a stated query set. It is worked off in blocks of at most
`BLOCK_SEEDS` seeds, so what is sent to the tasks is bounded; documents are
never shuffled. An item of fewer than `LEAST_WORDS` words identifies nothing and
is passed over; one of fewer than 8 words has to be matched whole.

Null and empty texts hold no item. Repeated rows are reported each; an item
that a document holds several times is reported once, with its best place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.texts import Spans, Texts, blocks, constants, runs_of, within

SEED_WORDS, LEAST_WORDS, WHOLE_BELOW = 3, 5, 8
COMMON, COMMON_SHARE = 20, 0.001
THRESHOLD = 0.5
MISS = 0.5
BLOCK_SEEDS = 1_000_000

_SEED = constants(SEED_WORDS, 11)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(texts: Texts) -> Spans:
    low = texts.lowered()
    return low._spans(_PLAIN[low.data])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score, and the range of the passage that it covers."""
    score, end = _forward(item, passage)
    back, length = _forward(item[::-1], passage[:end][::-1])
    return score, end - length, end


def _forward(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    ramp = MISS * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1)
    best, end = 0.0, 0
    for word in item:
        moved = np.empty_like(row)
        moved[0] = 0
        np.add(row[:-1], np.where(passage == word, 1.0, -MISS), out=moved[1:])
        np.maximum(moved, row - MISS, out=moved)
        np.maximum(moved, 0, out=moved)
        row = np.maximum.accumulate(moved + ramp) - ramp  # added words of the passage
        if row.max() > best:
            best, end = float(row.max()), int(row.argmax())
    return best, end


class Items:
    """A block of test items and the index of their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        seeds = [runs_of(w, SEED_WORDS, _SEED) for w in words]
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]).astype(np.int64)
        self.place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.distinct = np.unique(self.seed)
        #: Seeds that place their item alone.
        self.rare = np.ones(len(self.seed), bool)

    def mark_common(self, documents: dict[int, int], total: int) -> None:
        """Tell rare seeds from common speech, given each seed's count of documents and that of all."""
        if not len(self.seed):
            return
        count = np.array([documents.get(int(s), 0) for s in self.seed.view(np.int64)], float)
        order = np.lexsort((count, self.item))
        order = order[count[order] > 0]
        sorted_item = self.item[order]
        each = np.arange(len(self.words))
        first, last = np.searchsorted(sorted_item, each), np.searchsorted(sorted_item, each, "right")
        quartile = np.zeros(len(each))
        held = last > first
        quartile[held] = count[order[(first + (last - first) // 4)[held]]]
        limit = np.maximum(COMMON * (1 + quartile), COMMON_SHARE * total)
        self.rare = count <= limit[self.item]

    def met(self, hashes: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Where in a block of texts a seed begins."""
        if not len(self.distinct) or not len(hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
        return np.flatnonzero((self.distinct[at] == hashes) & ok)

    def found(self, names: np.ndarray, met: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """Item, score and word range of each item that one text holds. met: its
        words that begin a seed; hashes: those seeds."""
        if not len(met):
            return
        low, high = np.searchsorted(self.seed, hashes, "left"), np.searchsorted(self.seed, hashes, "right")
        times = high - low
        index = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, start = self.item[index], np.repeat(met, times) - self.place[index]
        order = np.lexsort((start, item))
        item, start, place, rare = item[order], start[order], self.place[index][order], self.rare[index][order]
        sizes = np.array([len(w) for w in self.words])
        # One stretch for hits of an item whose places in the text are near each other.
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > sizes[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        told = np.logical_or.reduceat(rare, first) | (np.minimum.reduceat(place, first) < np.maximum.reduceat(place, first))
        first, last = first[told], last[told]
        best: dict[int, tuple[float, int, int]] = {}
        for k, begin, end in zip(item[first], start[first], start[last], strict=True):
            words = self.words[k]
            slack = len(words) // 2 + 1
            a, b = max(0, begin - slack), min(len(names), end + len(words) + slack)
            passage = names[a:b]
            least = len(words) * (1.0 if len(words) < WHOLE_BELOW else THRESHOLD)
            if np.isin(words, passage).sum() < least:
                continue  # no alignment can reach the threshold
            score, x, y = align(words, passage)
            if score >= least and score > best.get(int(k), (0, 0, 0))[0]:
                best[int(k)] = (score, int(a + x), int(a + y))
        for k, (score, x, y) in sorted(best.items()):
            yield k, score / len(self.words[k]), x, y


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The benchmark's items in blocks of a bounded number of seeds."""
    held = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    seeds = held.agg(F.sum(F.size(F.split("text", r"\s+"))), F.count(F.lit(1))).first()
    number = -(-int(seeds[0] or 0) // (BLOCK_SEEDS // 2)) or 1
    for b in range(number):
        rows = held.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == b).distinct().orderBy("item", "text").toArrow()
        texts = Texts(rows.column("text").combine_chunks())
        words = plain_words(texts)
        names = words.hashes()
        lists = [names[a:z] for a, z in zip(words.bounds, words.bounds[1:], strict=False)]
        ids = rows.column("item").to_pylist()
        kept = [i for i, w in enumerate(lists) if len(w) >= LEAST_WORDS]
        yield Items([ids[i] for i in kept], [lists[i] for i in kept])


def _over_seeds(docs: DataFrame, text: str, items, work, keys: list[str], schema: str) -> DataFrame:
    """work(part, words, names, seed hashes, places of seeds) for each block of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in batches:
            for part, texts in blocks(batch, text):
                words = plain_words(texts)
                names = words.hashes()
                hashes = runs_of(names, SEED_WORDS, _SEED)
                met = block.met(hashes, within(words.bounds, SEED_WORDS, len(hashes)))
                yield work(block, part, words, names, hashes, met)

    return docs.select(*keys, text).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: key, item, `score`, and
    `first_word` and `last_word`, the place among the document's words."""
    context = docs.sparkSession.sparkContext
    key_kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType
    item_arrow = pa.int64() if item_kind.simpleString() in ("int", "bigint", "smallint", "tinyint") else pa.string()

    def count(block: Items, part, words, names, hashes, met) -> pa.RecordBatch:
        owner = np.searchsorted(words.bounds, met, side="right") - 1
        once = np.unique(np.column_stack([hashes[met].view(np.int64), owner]), axis=0)[:, 0] if len(met) else np.zeros(0, np.int64)
        seeds, documents = np.unique(once, return_counts=True)
        # The row without seed counts all documents.
        return pa.RecordBatch.from_arrays(
            [pa.array([*seeds.tolist(), None], pa.int64()), pa.array([*documents.tolist(), part.num_rows], pa.int64())], ["seed", "documents"]
        )

    def search(block: Items, part, words, names, hashes, met) -> pa.RecordBatch:
        rows: list[tuple] = []
        owner = np.searchsorted(words.bounds, met, side="right") - 1
        for i in np.unique(owner):
            first, last = words.bounds[i], words.bounds[i + 1]
            mine = met[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
            rows += [(int(i), *r) for r in block.found(names[first:last], mine - first, hashes[mine])]
        keys = part.column(part.schema.get_field_index(key)).take(pa.array([r[0] for r in rows], pa.int64()))
        ids = [block.ids[r[1]] for r in rows]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(ids if item_arrow == pa.int64() else [str(x) for x in ids], item_arrow),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[3] for r in rows], pa.int64()),
                pa.array([r[4] - 1 for r in rows], pa.int64()),
            ],
            [key, item, "score", "first_word", "last_word"],
        )

    found = None
    schema = f"`{key}` {key_kind}, `{item}` {'long' if item_arrow == pa.int64() else 'string'}, score double, first_word long, last_word long"
    for block in item_blocks(benchmark, item, item_text):
        counted = _over_seeds(docs, text, context.broadcast(block), count, [], "seed long, documents long")
        # At most one row for each seed of the block, and one for all documents.
        totals = counted.groupBy("seed").agg(F.sum("documents").alias("documents")).toArrow()
        documents = dict(zip(totals.column("seed").to_pylist(), totals.column("documents").to_pylist(), strict=True))
        block.mark_common(documents, documents.pop(None, 0))
        part = _over_seeds(docs, text, context.broadcast(block), search, [key], schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn(item, F.col(item).cast(item_kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no test item. Rows are told apart by a
    hash of key and text, so rows with one key, or none, are judged each by itself."""
    row = F.xxhash64(key, text)
    held = contaminated(docs.select(row.alias("__row"), text), benchmark, "__row", text, item, item_text).select(F.col("__row").alias("__held")).distinct()
    return docs.join(held, row == F.col("__held"), "left_anti")
