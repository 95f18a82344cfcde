"""Operator 13: phrase collocations by best-first growth of phrases.

A phrase of two to four words that occurs `LEAST` times is a candidate. Cutting
it in two parts that occur l and r times gives 2000000 * a / (l + r) points,
rounded down; its lowest cut counts. Single words and pairs are counted for all
texts. Longer phrases grow only where they can matter:

* A phrase of a occurrences that begins with p has at most f(p), and the rest
  behind each cut of p occurs at least a times. So no phrase that begins with p
  scores more than 2000000 * f(p) / (l + f(p)), whatever follows; l is the part
  before a cut of p. The same holds for phrases that end with p and the part
  behind a cut. These bounds only need counts of p and its parts.
* Each language has a frontier t, at first the score of its 4000th pair. Only
  phrases whose beginning and end can reach t grow, best bounds first, and those
  that hold a candidate of score t or more, since they may drop it. If a language
  then has 2000 survivors of t or more, nothing below t can change them, ties
  included; else its frontier goes on to the pair four times as far.

Which phrases may grow is kept in a table of `SLOTS` flags by hash, the same size
for any corpus: a chance hit costs a count, never a phrase. Counts are exact.
Words are named by 64 bits of hash; counting adds up inside a task first, so a
frequent phrase sends a row for each pool of some blocks of text. What is left
is mostly rare phrases, so it goes to the task of its key as it is: a second
table of them before the shuffle would take memory and save little.

Null languages are `und`; null and empty texts have no words. Repeated rows
count again. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrina.llm.shared import Workspace
from vitrina.llm.texts import Spans, Texts, blocks, mix

LEAST = 30
TOP = 2000
SCALE = 2_000_000
DROP_PERCENT = 80
#: The frontier starts at the score of the pair of this rank in its language.
START, STEP = 2 * TOP, 4
SLOTS_BITS, _PAGE_BITS = 24, 12
SLOTS = 1 << SLOTS_BITS
#: Bytes of text cut at once, phrases that are added up together, and rows of a batch sent on.
_TEXT, _POOL, _SENT = 1 << 18, 1 << 18, 1 << 15
#: Bytes of a batch of texts on its way from Spark to a task's Python.
_READ = 1 << 22

_FREQUENT, _GROWS_RIGHT, _GROWS_LEFT, _HIGH = 1, 2, 4, 8

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class _Words:
    """The words of a block of texts: names, languages, and which stand next to each other in a piece."""

    def __init__(self, texts: Texts, langs: pa.Array) -> None:
        kind = _KIND[texts.data]
        self.spans: Spans = texts._spans(kind == 0)
        self.names = self.spans.hashes()
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[self.spans.owner()]
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest()) for x in self.langs.to_pylist()], np.uint64)
        self._seed = seeds[self.lang] if len(seeds) else np.zeros(0, np.uint64)
        pieces = np.cumsum(kind == 2, dtype=np.int64)[self.spans.starts] if len(self.spans) else np.zeros(0, np.int64)
        own = self.spans.owner()
        self.next_too = (pieces[1:] == pieces[:-1]) & (own[1:] == own[:-1])

    def together(self, size: int) -> np.ndarray:
        """Whether the `size` words from each word on stand in one piece."""
        n = max(0, len(self.names) - size + 1)
        ok = np.ones(n, bool)
        for j in range(size - 1):
            ok &= self.next_too[j : j + n]
        return ok

    def flags(self, size: int, table: np.ndarray) -> np.ndarray:
        """The flags of the phrase of `size` words from each word on."""
        n = max(0, len(self.names) - size + 1)
        return table[_slots(self._seed[:n], [self.names[j : j + n] for j in range(size)])]


def _slots(seed: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    x = seed.copy()
    for w in words:
        x = mix(x ^ w) + np.uint64(len(words))
    return mix(x) >> np.uint64(64 - SLOTS_BITS)


def _cut(batch: pa.RecordBatch) -> Iterator[_Words]:
    for part, texts in blocks(batch, "text", _TEXT):
        yield _Words(texts.lowered(), part.column(part.schema.get_field_index("lang")))


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, w1, word, f of every word."""

    def first_seen(words: _Words) -> pa.Table:
        order = np.lexsort((words.names, words.lang))
        names, lang = words.names[order], words.lang[order]
        new = np.ones(len(order), bool)
        new[1:] = (names[1:] != names[:-1]) | (lang[1:] != lang[:-1])
        at = np.flatnonzero(new)
        starts, stops = words.spans.starts[order[at]], words.spans.stops[order[at]]
        lengths = stops - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        body = words.spans.texts.data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]
        spelled = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)])
        return pa.table(
            {
                "lang": words.langs.take(pa.array(lang[at])),
                "w1": names[at].view(np.int64),
                "word": spelled.cast(pa.string()),
                "f": np.diff(np.append(at, len(order))),
            }
        )

    return _pooled(docs, first_seen, ["lang", "w1", "word"], "lang string, w1 long, word string, f long")


def _phrase_counts(docs: DataFrame, size: int, grows: Callable[[_Words], np.ndarray]) -> DataFrame:
    """lang, w1 to w<size>, f of the phrases whose occurrences `grows` lets through."""
    names = [f"w{j + 1}" for j in range(size)]

    def occurrences(words: _Words) -> pa.Table:
        at = np.flatnonzero(words.together(size) & grows(words)) if len(words.names) >= size else np.zeros(0, np.int64)
        columns = {"lang": words.langs.take(pa.array(words.lang[at]))}
        columns |= {name: words.names[at + j].view(np.int64) for j, name in enumerate(names)}
        return pa.table(columns | {"f": np.ones(len(at), np.int64)})

    return _pooled(docs, occurrences, ["lang", *names], f"lang string, {', '.join(f'{n} long' for n in names)}, f long")


def _pooled(docs: DataFrame, rows: Callable[[_Words], pa.Table], keys: list[str], schema: str) -> DataFrame:
    """The rows of all blocks, added up by key: first in pools inside a task, then over all."""

    def summed(pool: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(pool).group_by(keys, use_threads=False).aggregate([("f", "sum")])
        return found.select([*keys, "f_sum"]).rename_columns([*keys, "f"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.Table] = []
        for batch in batches:
            for words in _cut(batch):
                pool.append(rows(words))
                if sum(t.num_rows for t in pool) >= _POOL:
                    pool = [summed(pool)]
                    if pool[0].num_rows >= _POOL // 2:
                        yield from pool.pop().to_batches(max_chunksize=_SENT)
        if pool:
            yield from summed(pool).to_batches(max_chunksize=_SENT)

    return docs.mapInArrow(run, schema).repartition(*keys).groupBy(*keys).agg(F.sum("f").alias("f"))


def _flag_table(phrases: DataFrame) -> np.ndarray:
    """`SLOTS` bytes: the flags of all phrases (lang, w1, ..., flags) that share a slot."""
    names = [c for c in phrases.columns if c.startswith("w")]
    page = 1 << _PAGE_BITS

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest()) for x in langs.dictionary.to_pylist()], np.uint64)
            words = [batch.column(j + 1).to_numpy(zero_copy_only=False).view(np.uint64) for j in range(len(names))]
            if batch.num_rows:
                slots = _slots(seeds[langs.indices.to_numpy(zero_copy_only=False)], words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slots >> np.uint64(_PAGE_BITS)).astype(np.int64)), pa.array((slots % np.uint64(page)).astype(np.int64)), batch.column(len(names) + 1)],
                    ["page", "at", "flags"],
                )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers, at, flags = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for number in np.unique(numbers):
                mine = numbers == number
                np.bitwise_or.at(pages.setdefault(int(number), np.zeros(page, np.uint8)), at[mine], flags[mine].astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pages), pa.int64()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], ["page", "bytes"]
        )

    chosen = phrases.select("lang", *names, F.col("flags").cast("long").alias("flags"))
    slots = chosen.mapInArrow(place, "page long, at long, flags long").groupBy("page", "at").agg(F.bit_or("flags").alias("flags"))
    pages = slots.repartition("page").mapInArrow(fill, "page long, bytes binary")
    table = np.zeros(SLOTS, np.uint8)
    for row in pages.toLocalIterator():
        table[row.page * page : (row.page + 1) * page] = np.frombuffer(row.bytes, np.uint8)
    return table


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"cast(cast({a} as decimal(20)) * {SCALE} div (cast({left} as decimal(20)) + cast({right} as decimal(20))) as long)")


def _reaches(part: str) -> Column:
    """Whether a phrase that has f occurrences and a part of it cut off can still score t."""
    return F.expr(f"cast(f as decimal(20)) * {SCALE} >= cast(t as decimal(10)) * (cast({part} as decimal(20)) + f)")


def _lowest(cuts: list[tuple[str, str]]) -> list[Column]:
    """score, l, r of the cut with the lowest score, the first of equal ones. Null where a part is not counted."""
    scored = [F.struct(_score("f", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    known = F.lit(True)
    for left, right in cuts:
        known &= F.col(left).isNotNull() & F.col(right).isNotNull()
    best = F.when(known, F.least(*scored) if len(scored) > 1 else scored[0])
    return [best.getField(c).alias(c) for c in ("score", "l", "r")]


def _frontiers(pairs: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """lang, t of the open languages: the score of the pair of this rank, 0 if there are fewer."""
    counted = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("pairs"))
    above = F.sum("pairs").over(W.partitionBy("lang").orderBy(F.col("score").desc()))
    reached = counted.withColumn("above", above).where(F.col("above") >= rank).groupBy("lang").agg(F.max("score").alias("t"))
    return open_.join(reached, "lang", "left").fillna(0, ["t"])


def _flag(bit: int, when: Column) -> Column:
    return F.when(when, bit).otherwise(0)


def _pairs(counted: DataFrame, words: DataFrame) -> DataFrame:
    left = words.select("lang", "w1", F.col("f").alias("f_1"))
    right = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f_2"))
    known = counted.where(F.col("f") >= LEAST).join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    return known.select("lang", "w1", "w2", "f", *_lowest([("f_1", "f_2")]))


def _triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The parts of a triple are a pair and a word; a pair's own parts are words."""
    first = pairs.select("lang", "w1", "w2", F.col("f").alias("f_12"), F.col("l").alias("f_1"))
    last = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f_23"), F.col("r").alias("f_3"))
    known = counted.where(F.col("f") >= LEAST).join(first, ["lang", "w1", "w2"]).join(last, ["lang", "w2", "w3"])
    return known.select("*", *_lowest([("f_1", "f_23"), ("f_12", "f_3")]))


def _fours(counted: DataFrame, triples: DataFrame, pairs: DataFrame) -> DataFrame:
    first = triples.select("lang", "w1", "w2", "w3", F.col("f").alias("f_123"))
    last = triples.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("f").alias("f_234"))
    head = pairs.select("lang", "w1", "w2", F.col("f").alias("f_12"), F.col("l").alias("f_1"))
    tail = pairs.select("lang", F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("f").alias("f_34"), F.col("r").alias("f_4"))
    known = (
        counted.where(F.col("f") >= LEAST)
        .join(first, ["lang", "w1", "w2", "w3"], "left")
        .join(last, ["lang", "w2", "w3", "w4"], "left")
        .join(head, ["lang", "w1", "w2"])
        .join(tail, ["lang", "w3", "w4"])
    )
    return known.select("lang", "w1", "w2", "w3", "w4", "f", *_lowest([("f_1", "f_234"), ("f_12", "f_34"), ("f_123", "f_4")]))


def _held(longer: DataFrame, size: int, part: int) -> DataFrame:
    """The phrases of `part` words inside longer ones, with the most occurrences of one that holds them."""
    inner = [F.struct(*[F.col(f"w{i + j + 1}").alias(f"w{j + 1}") for j in range(part)]) for i in range(size - part + 1)]
    each = longer.select("lang", F.col("f").alias("longer"), F.explode(F.array(*inner)).alias("p")).select("lang", "p.*", "longer")
    return each.groupBy("lang", *[f"w{j + 1}" for j in range(part)]).agg(F.max("longer").alias("longer"))


def _undropped(phrases: DataFrame, size: int, holders: DataFrame) -> DataFrame:
    names = [f"w{j + 1}" for j in range(size)]
    dropped = F.expr(f"coalesce(cast(longer as decimal(20)) * 100 >= cast(f as decimal(20)) * {DROP_PERCENT}, false)")
    return phrases.join(holders, ["lang", *names], "left").where(~dropped)


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    work = Workspace(docs.sparkSession, "collocations", {"spark.sql.execution.arrow.maxBytesPerBatch": str(_READ)})
    broadcast = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")

    words = work.write(_word_counts(docs), "words")
    frequent = words.where(F.col("f") >= LEAST)
    known = broadcast(_flag_table(frequent.select("lang", "w1", F.lit(_FREQUENT).alias("flags"))))

    def both_frequent(block: _Words) -> np.ndarray:
        often = block.flags(1, known.value) > 0
        return often[:-1] & often[1:]

    counted = work.write(_phrase_counts(docs, 2, both_frequent).where(F.col("f") >= LEAST), "pair-counts")
    pairs = work.write(_pairs(counted, frequent), "pairs")
    work.drop(counted)

    open_, rank, settled = words.select("lang").distinct(), START, []
    while True:
        frontier = work.write(_frontiers(pairs, open_, rank), "frontier")
        grown, used = _grown(work, docs, pairs, frontier)
        found = work.write(grown, "survivors")
        work.drop(*used)
        counts = frontier.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("found")), "lang", "left")
        done = F.coalesce("found", F.lit(0)) >= TOP
        done = done | (F.col("t") == 0)
        settled.append(found.join(counts.where(done).select("lang"), "lang", "left_semi"))
        open_ = work.write(counts.where(~done).select("lang"), "open")
        if open_.isEmpty():
            break
        docs, rank = docs.join(open_, "lang", "left_semi"), rank * STEP

    best = settled[0]
    for more in settled[1:]:
        best = best.unionByName(more)
    for j in range(1, 5):
        best = best.join(frequent.select("lang", F.col("w1").alias(f"w{j}"), F.col("word").alias(f"word{j}")), ["lang", f"w{j}"], "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"word{j}" for j in range(1, 5)]))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _grown(work: Workspace, docs: DataFrame, pairs: DataFrame, frontier: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """lang, w1 to w4, a, l, r, score of all phrases of at least the frontier's
    score that no longer one drops; and the tables that this is read from."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    high = F.col("score") >= F.col("t")
    pairs = pairs.join(frontier, "lang")
    flags = F.lit(_FREQUENT) + _flag(_GROWS_RIGHT, _reaches("l")) + _flag(_GROWS_LEFT, _reaches("r"))
    by_pair = broadcast(_flag_table(pairs.select("lang", "w1", "w2", flags.alias("flags"))))

    def third_word(block: _Words) -> np.ndarray:
        pair = block.flags(2, by_pair.value)
        first, last = pair[:-1], pair[1:]
        return ((first & last & _FREQUENT) > 0) & (((first & _GROWS_RIGHT) | (last & _GROWS_LEFT)) > 0)

    counted = work.write(_phrase_counts(docs, 3, third_word).where(F.col("f") >= LEAST), "triple-counts")
    triples = work.write(_triples(counted, pairs).join(frontier, "lang"), "triples")
    work.drop(counted)
    flags = (
        _flag(_GROWS_RIGHT, _reaches("f_1") & _reaches("f_12")) + _flag(_GROWS_LEFT, _reaches("f_3") & _reaches("f_23")) + _flag(_HIGH, high)
    )
    by_triple = broadcast(_flag_table(triples.select("lang", "w1", "w2", "w3", flags.alias("flags"))))

    def fourth_word(block: _Words) -> np.ndarray:
        triple = block.flags(3, by_triple.value)
        first, last = triple[:-1], triple[1:]
        return (((first & _GROWS_RIGHT) > 0) & ((last & _GROWS_LEFT) > 0)) | (((first | last) & _HIGH) > 0)

    counted = work.write(_phrase_counts(docs, 4, fourth_word).where(F.col("f") >= LEAST), "four-counts")
    fours = work.write(_fours(counted, triples, pairs).join(frontier, "lang"), "fours")
    work.drop(counted)

    none = F.lit(None).cast("long")
    kept = [
        _undropped(pairs.where(high), 2, _held(triples, 3, 2)).withColumns({"w3": none, "w4": none}),
        _undropped(triples.where(high), 3, _held(fours, 4, 3)).withColumn("w4", none),
        fours.where(high),
    ]
    columns = ["lang", "w1", "w2", "w3", "w4", F.col("f").alias("a"), "l", "r", "score"]
    found = kept[0].select(*columns).unionByName(kept[1].select(*columns)).unionByName(kept[2].select(*columns))
    return found, [triples, fours]
