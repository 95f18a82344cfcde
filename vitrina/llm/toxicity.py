"""Operator 3: toxicity by a factorization machine over hashed terms.

A text is the set of its distinct lower-cased terms (runs of letters and digits,
and the beginnings of each, since insults are inflected), hashed to slots. The
machine adds a weight for each slot and, through short vectors, one for each
pair of slots, so that an insult next to a group mention can weigh more than
the two apart.

It is fitted on a bounded sample of labelled rows, equal texts once. Only slots
whose share differs between the two classes by `LEAST_Z` standard errors take
part, so that names and chance words of few texts do not. Null and empty texts score by the bias
alone, repeated rows score alike, and without labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.quality import sample
from vitrina.llm.texts import Spans, Texts, blocks, mix

#: Labelled rows that the machine is fitted on at most: those with the lowest hashes of their id.
TRAINING_ROWS = 12_000
SLOTS, FACTORS, LEAST_Z = 1 << 20, 4, 4.5

#: Lengths, in characters, of the beginnings that count as terms of their own.
BEGINNINGS = (3, 4, 5, 7)

# Characters that end or start a term: ASCII other than letters and digits.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct slots of each text, sorted."""
    low = texts.lowered()
    spans = low._spans(_PLAIN[low.data])
    owner = spans.owner()
    points = np.append(np.flatnonzero((low.data & 0xC0) != 0x80), len(low.data))
    first = np.searchsorted(points, spans.starts)
    shift = 64 - int(SLOTS).bit_length() + 1
    found = [owner * SLOTS + (spans.hashes() >> np.uint64(shift)).astype(np.int64)]
    for n in BEGINNINGS:
        stops = points[np.minimum(first + n, len(points) - 1)]
        longer = stops < spans.stops
        part = Spans(low, spans.starts[longer], stops[longer])
        mark = np.uint64(n * 0x9E3779B1)
        found.append(owner[longer] * SLOTS + (mix(part.hashes() ^ mark) >> np.uint64(shift)).astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs // SLOTS, pairs % SLOTS


class Machine:
    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.bias, self.weight, self.factor = bias, weight.astype(np.float32), factor.astype(np.float32)

    def margin(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        known = self.weight[slot] != 0
        row, slot = row[known], slot[known]
        out = np.full(n, self.bias) + np.bincount(row, self.weight[slot], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[slot, f].astype(float)
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def probability(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, slot, n), -50, 50)))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad over small batches on the log loss; both classes weigh alike."""
    weight = np.zeros(SLOTS)
    factor = np.zeros((SLOTS, FACTORS))
    distinct = {(r.tobytes(), t): i for i, (r, t) in enumerate(zip(rows, y, strict=True))}
    kept = sorted(distinct.values())
    rows, y = [rows[i] for i in kept], y[kept]
    if not len(y) or y.min() == y.max():
        return Machine(-50.0 if not len(y) or not y[0] else 50.0, weight, factor)
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    one, zero = y.sum(), len(y) - y.sum()
    with_one = np.bincount(flat, y[owner], SLOTS)
    with_zero = np.bincount(flat, minlength=SLOTS) - with_one
    shared = (with_one + with_zero + 1) / (one + zero + 2)
    z = (with_one / one - with_zero / zero) / np.sqrt(shared * (1 - shared) * (1 / one + 1 / zero))
    usable = np.abs(z) >= LEAST_Z
    owner, flat = owner[usable[flat]], flat[usable[flat]]
    bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
    random = np.random.default_rng(seed)
    factor[usable] = random.normal(0, 0.01, (int(usable.sum()), FACTORS))
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias, bias_sum = 0.0, 1e-8
    weight_sum, factor_sum = np.full(SLOTS, 1e-8), np.full((SLOTS, FACTORS), 1e-8)
    for _ in range(epochs):
        order = random.permutation(len(y))
        for first in range(0, len(order), 64):
            chosen = order[first : first + 64]
            slots = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [bounds[i + 1] - bounds[i] for i in chosen])
            v = factor[slots]
            sums = np.zeros((len(chosen), FACTORS))
            np.add.at(sums, row, v)
            squares = np.bincount(row, (v * v).sum(1), len(chosen))
            margin = bias + np.bincount(row, weight[slots], len(chosen)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[chosen]) * share[chosen] / len(chosen)
            bias_sum += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_sum)
            if not len(slots):
                continue
            touched, where = np.unique(slots, return_inverse=True)
            slope = np.bincount(where, error[row], len(touched)) + decay * weight[touched]
            weight_sum[touched] += slope**2
            weight[touched] -= rate * slope / np.sqrt(weight_sum[touched])
            turn = error[row][:, None] * (sums[row] - v)
            slopes = np.column_stack([np.bincount(where, turn[:, f], len(touched)) for f in range(FACTORS)])
            slopes += decay * factor[touched]
            factor_sum[touched] += slopes**2
            factor[touched] -= 0.3 * rate * slopes / np.sqrt(factor_sum[touched] + 1e-6)
    return Machine(bias, weight, factor)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Machine:
    """Fit on at most `rows` labelled texts; only their slots reach the driver."""
    chosen = F.broadcast(sample(labels, key, label, rows))  # at most `rows` rows of two numbers
    labelled = docs.select(key, text).join(chosen, key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                owner, slot = terms(texts)
                bounds = np.searchsorted(owner, np.arange(texts.n + 1)).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot, pa.int32()))
                keys, y = (part.column(part.schema.get_field_index(c)) for c in (key, label))
                yield pa.RecordBatch.from_arrays([keys, y.cast(pa.int32()), slots], ["id", "y", "slots"])

    kind = docs.schema[key].dataType.simpleString()
    found = labelled.mapInArrow(run, f"id {kind}, y int, slots array<int>").toArrow().sort_by("id")
    rows_of = found.column("slots").combine_chunks()
    values, starts = rows_of.flatten().to_numpy(), np.concatenate([[0], np.cumsum(rows_of.value_lengths().to_numpy())])
    return fit([values[a:b] for a, b in zip(starts, starts[1:], strict=False)], found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: its key, `score` (0 to 1) and `predicted` (1 from the threshold on)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                p = machine.probability(*terms(texts), texts.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(key)), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    [key, "score", "predicted"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
