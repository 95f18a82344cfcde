"""Operator 6: quality rules by gradient-boosted trees over document statistics.

The statistics of a text are computed for whole blocks of texts at once. Trees
are grown on histograms of a bounded sample of labelled rows; chosen features
may only lower (or raise) the score. The fitted trees are flattened into node
arrays, and a block of rows walks them level by level.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged each; with no labelled rows the model keeps every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.texts import Texts, blocks, constants, mix, runs_of, within

#: Labelled rows that the trees are fitted on at most: those with the lowest hashes of their id.
TRAINING_ROWS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the model and the direction in which the score may move with each (0: free).
FEATURES = {
    "words_log": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "end_mark_per_word": 0,
    "lines_per_word": 0,
    "distinct_word_share": 0,
    "long_word_share": 0,
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK, _END = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?@^~=+_{}[]\\/")] = True
_END[list(b".,;:")] = True


def _per_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def _later_equal(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many of its values equal an earlier one of the same text."""
    keys = np.sort(mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1))))
    equal = keys[1:] == keys[:-1]
    if not equal.any():
        return np.zeros(n, np.int64)
    own = owner[np.argsort(mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1))), kind="stable")]
    return np.bincount(own[1:][equal], minlength=n)


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts of each text, and its row of model features."""
    data, n = texts.data, texts.n
    words = texts.words()
    owner, hashes = words.owner(), words.hashes()
    n_words = words.counts()
    points = (data & 0xC0) != 0x80
    blank = np.isin(data, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    word_chars = _per_text(points & ~blank, texts)
    n_symbols = _per_text(_SYMBOL[data], texts)

    lines = texts.lines()
    worded = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.stops)
    line_owner = lines.owner()[worded]
    n_lines = np.bincount(line_owner, minlength=n)
    n_dup_lines = _later_equal(lines.hashes()[worded], line_owner, n)

    n_repeat = np.zeros(n, np.int64)
    if len(hashes) >= 3:
        windows = runs_of(hashes, 3, constants(3, 6))
        real = within(words.bounds, 3, len(windows))
        keys = mix(windows ^ mix(owner[: len(windows)].astype(np.uint64) + np.uint64(1)))
        places = np.flatnonzero(real)
        order = places[np.argsort(keys[places])]
        again = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][again]] = True
        twice[order[:-1][again]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        n_repeat = np.bincount(owner[covered], minlength=n)

    w = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    repeated_words = _later_equal(hashes, owner, n)
    long = np.bincount(owner[(words.stops - words.starts) > 12], minlength=n)
    features = np.column_stack(
        [
            np.log1p(n_words),
            word_chars / w,
            n_symbols / w,
            n_dup_lines / np.maximum(n_lines, 1),
            n_repeat / w,
            _per_text(_UPPER[data], texts) / chars,
            _per_text(_DIGIT[data], texts) / chars,
            _per_text(_MARK[data], texts) / chars,
            _per_text(_END[data], texts) / w,
            n_lines / w,
            1 - repeated_words / w,
            long / w,
        ]
    )
    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat), strict=True))
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


class Trees:
    """Boosted trees as node arrays; node 0 of each tree is its root."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray) -> None:
        #: each of the arrays is trees x nodes; a leaf has feature -1, the right child is left + 1
        self.start, self.feature, self.cut, self.left, self.value = start, feature, cut, left, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, left, value in zip(self.feature, self.cut, self.left, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = left[node] + (x[rows, np.maximum(feature[node], 0)] > cut[node])
                node = np.where(inner, go, node)
            total += value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    direction: tuple[int, ...] = tuple(FEATURES.values()),
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 48,
    weight: float = 1.0,
    least: float = 5.0,
) -> Trees:
    """Grow trees for the log loss. A split on a feature with a direction is only
    taken if its two values keep to it, and their middle then bounds what lies
    below on either side, so the sum of trees is monotonic in that feature."""
    n, m = x.shape
    nodes = 2 ** (depth + 1) - 1
    shape = (0, nodes)
    if not n or y.min() == y.max():
        start = 0.0 if not n else (6.0 if y[0] else -6.0)
        return Trees(start, *(np.zeros(shape, t) for t in (np.int64, float, np.int64, float)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, start)
    grown: list[tuple[np.ndarray, ...]] = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.full(nodes, -1), np.zeros(nodes)
        left, value = np.zeros(nodes, np.int64), np.zeros(nodes)
        used = 1
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            own = float(np.clip(-total_g / (total_h + weight), low, high))
            value[node] = rate * own
            best = None
            if level < depth:
                whole = total_g**2 / (total_h + weight)
                for j in range(m):
                    size = len(cuts[j]) + 1
                    lg = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                    lh = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                    if not len(lg):
                        continue
                    rg, rh = total_g - lg, total_h - lh
                    a = np.clip(-lg / (lh + weight), low, high)
                    b = np.clip(-rg / (rh + weight), low, high)
                    gain = lg**2 / (lh + weight) + rg**2 / (rh + weight) - whole
                    gain[(lh < least) | (rh < least) | (direction[j] * (b - a) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, a[k], b[k])
            if best is None:
                margin[rows] += value[node]
                continue
            _, j, k, a, b = best
            feature[node], cut[node], left[node] = j, cuts[j][k], used
            used += 2
            below = binned[rows, j] <= k
            middle = (a + b) / 2
            bounds = ((low, high), (low, high))
            if direction[j] > 0:
                bounds = ((low, middle), (middle, high))
            elif direction[j] < 0:
                bounds = ((middle, high), (low, middle))
            todo.append((left[node], rows[below], *bounds[0], level + 1))
            todo.append((left[node] + 1, rows[~below], *bounds[1], level + 1))
        grown.append((feature, cut, left, value))
    return Trees(start, *(np.array(part) for part in zip(*grown, strict=True)))


def sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled rows, those whose key has the lowest hash."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.select(key, label).orderBy(F.xxhash64(key), key, label).limit(rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Fit on at most `rows` labelled texts; only their statistics reach the driver."""
    chosen = F.broadcast(sample(labels, key, label, rows))  # at most `rows` rows of two numbers
    labelled = docs.select(key, text).join(chosen, key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                y = part.column(part.schema.get_field_index(label)).cast(pa.float64())
                x = pa.array(list(statistics(texts)[1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([y, x], ["y", "x"])

    found = labelled.mapInArrow(run, "y double, x array<double>").toPandas()
    x = np.array(found.x.tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the rows' order must not depend on the tasks'
    return fit(x[order], found.y.to_numpy(float)[order])


def judge(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: its key, the base counts, `base_failed`, `score` and `kept`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                base, features = statistics(texts)
                failed = base_failed(base)
                score = trees.probability(features)
                kept = ~failed & (score >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index(key)),
                        *(pa.array(v, pa.int64()) for v in base.values()),
                        pa.array(failed),
                        pa.array(score),
                        pa.array(kept),
                    ],
                    [key, *base, "base_failed", "score", "kept"],
                )

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in BASE)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {counts}, base_failed boolean, score double, kept boolean")


def passing(docs: DataFrame, trees: Trees, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rule nor the trees reject."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, text):
                base, features = statistics(texts)
                yield part.filter(pa.array(~base_failed(base) & (trees.probability(features) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
