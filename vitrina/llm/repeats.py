"""Operator 9: substring dedup by recompression.

Words are letters. A round of recompression splits the alphabet by a bit of
each letter's name and joins every neighbouring pair whose first is of the one
half and whose second is of the other; the pair's name is a hash of the two, so
equal pairs have the same name in all documents without any table of names. A
pair is joined or not by its two letters alone. Equal stretches of words
therefore have the same symbols inside; only the outermost symbol at either end
may differ. (Runs of one letter lie in one half and stay single letters: named
as runs they would differ inside longer runs.)

1. Anchors: a stretch of 20 words holds at least 9 common symbols after a round,
   that is 6 sequences of 4. Of each 6 in a row the one with the least hash is
   an anchor, so equal stretches have the same anchors inside. Spark counts the
   anchors of all documents; where all are met twice, repeats can be.
2. Verification: only the windows of 20 words all of whose anchors are shared
   are named (96 bits) and grouped; each group's least doc_id owns the window,
   the others lose its words. Repeats inside one document are found in its task.

Groups are aggregated before they are joined, so a passage that a third of all
documents hold is never in one task. Windows are judged on the input.

Null and empty texts have no words. Rows with the same doc_id count as one
document; rows without doc_id are compared with nothing but themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.shared import Workspace
from vitrina.llm.texts import SEPARATOR, Spans, blocks, constants, mix, runs_of, within

WINDOW, ROUNDS, SEQUENCE = 20, 1, 4

_PAIR, _SEQUENCE, _WINDOW = constants(2, 91), constants(SEQUENCE, 92), (constants(WINDOW, 93), constants(WINDOW, 94))


def common_symbols() -> int:
    """Symbols that equal windows have in common at least after all rounds."""
    n = WINDOW
    for _ in range(ROUNDS):
        n = (n - 1) // 2  # the two outermost may differ, the others join in pairs at most
    return n


def recompress(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the first word of each (with
    the number of words at the end). bounds are the texts' ranges of words."""
    place = np.arange(len(names) + 1)
    first_of_text = np.zeros(len(names) + 1, bool)
    first_of_text[bounds] = True
    for r in range(ROUNDS):
        half = (names >> np.uint64(r)) & np.uint64(1)
        joined = np.zeros(len(names), bool)  # with the one before
        joined[1:] = (half[:-1] == 0) & (half[1:] == 1)
        joined &= ~first_of_text[place[:-1]]
        with_next = np.append(joined[1:], False)
        paired = mix(names * _PAIR[0] + np.append(names[1:], np.uint64(0)) * _PAIR[1])
        names = np.where(with_next, paired, names)[~joined]
        place = np.append(place[:-1][~joined], place[-1])
    return names, place


class Sequences:
    """The sequences of symbols in a block of texts, and of each `REACH` in a row the least hash."""

    REACH = common_symbols() - SEQUENCE + 1

    def __init__(self, names: np.ndarray, bounds: np.ndarray) -> None:
        symbols, self.place = recompress(names, bounds)
        symbol_bounds = np.searchsorted(self.place[:-1], bounds)
        self.hashes = runs_of(symbols, SEQUENCE, _SEQUENCE)
        n = len(self.hashes)
        inside = within(symbol_bounds, SEQUENCE, n)
        self.ranked = np.where(inside, self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        rows = max(0, n - self.REACH + 1)
        self.least = self.ranked[:rows].copy()
        for j in range(1, self.REACH):
            np.minimum(self.least, self.ranked[j : j + rows], out=self.least)
        #: rows of sequences that lie in one text
        self.whole = within(symbol_bounds, SEQUENCE + self.REACH - 1, rows)

    def anchors(self) -> np.ndarray:
        """The sequences that are the least of some row."""
        chosen = np.zeros(len(self.hashes), bool)
        rows = len(self.least)
        for j in range(self.REACH):
            chosen[j : j + rows] |= (self.least == self.ranked[j : j + rows]) & self.whole
        return np.flatnonzero(chosen)

    def unlike(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges of the rows whose least sequence is not shared: a window that
        holds one, and a word more on either side, is found nowhere else."""
        rows = len(self.least)
        held = np.zeros(rows, bool)
        for j in range(self.REACH):
            held |= (self.least == self.ranked[j : j + rows]) & shared[j : j + rows]
        at = np.flatnonzero(self.whole & ~held)
        return self.place[at], self.place[at + SEQUENCE + self.REACH - 1]


def windows(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the window that starts at each word."""
    return runs_of(names, WINDOW, _WINDOW[0]), runs_of(names, WINDOW, _WINDOW[1]) >> np.uint64(32)


def again_inside(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Which windows of one document also start earlier in it."""
    order = np.lexsort((np.arange(len(w1)), w2, w1))
    out = np.zeros(len(w1), bool)
    same = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
    out[order[1:][same]] = True
    return out


def _anchor_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                words = texts.words()
                found = Sequences(words.hashes(), words.bounds)
                chosen = found.anchors()
                first = found.place[chosen]
                owner = np.searchsorted(words.bounds, first, side="right") - 1
                ids = part.column(part.schema.get_field_index(key)).take(pa.array(owner))
                hashes = found.hashes[chosen].view(np.int64)
                at = (first - words.bounds[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), ids, pa.array(at)], ["anchor", "id", "at"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(run, f"anchor long, id {kind}, at int")


def _window_rows(marked: DataFrame) -> DataFrame:
    """w1, w2 and id of the windows whose anchors are all shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                words = texts.words()
                names = words.hashes()
                marks = part.column(part.schema.get_field_index("marks"))
                sequences = Sequences(names, words.bounds)
                shared = np.zeros(len(sequences.hashes), bool)
                # Rows of one id share their marks; those of another text mean no harm but may lie beyond this one.
                lengths = marks.value_lengths().to_numpy()
                at = marks.flatten().to_numpy()
                marked = (at + np.repeat(words.bounds[:-1], lengths))[at < np.repeat(words.counts(), lengths)]
                named = np.searchsorted(sequences.place, marked)
                shared[named[named < len(shared)]] = True
                begin, end = sequences.unlike(shared)
                # A window start from end - WINDOW + 1 to begin - 1 takes such a range in.
                edge = np.zeros(len(names) + 1, np.int64)
                low, high = np.maximum(end - WINDOW + 1, 0), np.maximum(begin, 0)
                np.add.at(edge, low[low < high], 1)
                np.add.at(edge, high[low < high], -1)
                alike = np.cumsum(edge[:-1]) == 0
                found = []
                for i in range(texts.n):
                    first, last = words.bounds[i], words.bounds[i + 1]
                    n = last - first - WINDOW + 1
                    if n <= 0:
                        continue
                    starts = np.flatnonzero(alike[first : first + n])
                    w1, w2 = windows(names[first:last])
                    fresh = ~again_inside(w1[starts], w2[starts])
                    starts = starts[fresh]
                    found.append((w1[starts], w2[starts], np.full(len(starts), i)))
                if not found:
                    continue
                w1, w2, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                ids = part.column(part.schema.get_field_index("id")).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.astype(np.uint32).view(np.int32)), ids],
                    ["w1", "w2", "id"],
                )

    kind = marked.schema["id"].dataType.simpleString()
    return marked.mapInArrow(run, f"w1 long, w2 int, id {kind}")


def _cut(words: Spans, gone: np.ndarray) -> list[bytes]:
    """Each text's words that stay, joined by one space."""
    texts, stay = words.texts, ~gone
    n = len(texts.data)
    edge = np.zeros(n + 1, np.int8)
    edge[words.starts[stay]] += 1
    edge[words.stops[stay]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # One separator behind each word; a text's last word may have none.
    behind = words.stops[stay]
    behind = behind[behind < n]
    take[behind[SEPARATOR[texts.data[behind]]]] = True
    data = np.where(SEPARATOR[texts.data], np.uint8(0x20), texts.data)
    kept = np.concatenate([[0], np.cumsum(take, dtype=np.int64)])[texts.offsets]
    out = data[take].tobytes()
    return [out[a:b].removesuffix(b" ") for a, b in zip(kept, kept[1:], strict=False)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, `n_words`, `n_removed` and `kept_text`."""
    work = Workspace(docs.sparkSession, "repeats")
    found = _anchor_rows(docs, key, text)
    twice = work.write(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    marks = work.write(found.join(twice, "anchor").groupBy("id").agg(F.collect_set("at").alias("marks")), "marks")

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    named = work.write(_window_rows(texts.join(marks, "id")), "windows")
    owners = named.groupBy("w1", "w2").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    later = named.join(owners.drop("last"), ["w1", "w2"]).where("id > owner")
    # By name, not by place: rows of one id may hold different texts.
    known = work.write(later.groupBy("id").agg(F.collect_set("w1").alias("known")), "known")
    work.drop(named)

    # Documents without a shared anchor repeat nothing, not even themselves.
    flags = marks.select("id").join(known, "id", "left").select(F.col("id").alias("__id"), F.coalesce("known", F.array().cast("array<long>")).alias("known"))
    joined = texts.join(flags, F.col("id") == F.col("__id"), "left").drop("__id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in blocks(batch, "text"):
                words = found.words()
                gone = np.zeros(len(words), bool)
                ids, lists = (part.column(part.schema.get_field_index(c)) for c in ("id", "known"))
                names = words.hashes()
                for i in range(found.n):
                    if not lists[i].is_valid and ids[i].is_valid:
                        continue
                    first, last = words.bounds[i], words.bounds[i + 1]
                    if last - first < WINDOW:
                        continue
                    w1, w2 = windows(names[first:last])
                    hit = again_inside(w1, w2)
                    if lists[i].is_valid and len(lists[i]):
                        hit |= np.isin(w1.view(np.int64), lists[i].values.to_numpy())
                    edge = np.zeros(last - first + 1, np.int64)
                    at = np.flatnonzero(hit)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    gone[first:last] = np.cumsum(edge[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words.counts()), pa.array(np.diff(removed)), pa.array(_cut(words, gone), pa.binary()).cast(pa.string())],
                    [key, "n_words", "n_removed", "kept_text"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return joined.select("id", "text", "known").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_text string")
