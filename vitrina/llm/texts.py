"""Vectorised text work inside Arrow tasks: words, lines and their hashes.

A word is a run of bytes other than space and the controls 0x09 to 0x0D. All
of these are single bytes in UTF-8, so words can be cut without decoding. Null
texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text forms its own block.
BLOCK_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, "Texts"]]:
    """The batch in slices of about `size` bytes of text, each with its texts."""
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(first, i - first), Texts(texts.slice(first, i - first))
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first), Texts(texts.slice(first))


class Texts:
    """The bytes of several texts in a row; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        filled = pc.fill_null(column, "").cast(pa.large_binary())
        joined = pa.concat_arrays([filled])
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        body = joined.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.n = len(filled)
        if lower:
            self.data = LOWER[self.data]

    def lowered(self) -> "Texts":
        """The same texts with A-Z in lower case."""
        out = object.__new__(Texts)
        out.data, out.offsets, out.n = LOWER[self.data], self.offsets, self.n
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def _spans(self, solid: np.ndarray) -> "Spans":
        n = len(solid)
        cuts = self.offsets[:-1][np.diff(self.offsets) > 0]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[cuts] = solid[cuts]
        ends = cuts[cuts > 0] - 1
        last[ends] = solid[ends]
        starts = np.flatnonzero(first)
        stops = np.flatnonzero(last) + 1 if n else starts
        return Spans(self, starts, stops)

    def words(self) -> "Spans":
        return self._spans(~SEPARATOR[self.data])

    def lines(self) -> "Spans":
        """The \\n-split lines that are not empty."""
        return self._spans(self.data != 10)


class Spans:
    """Stretches of bytes in text order; none reaches over the end of its text."""

    def __init__(self, texts: Texts, starts: np.ndarray, stops: np.ndarray) -> None:
        self.texts, self.starts, self.stops = texts, starts, stops
        #: spans of text i are bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(starts, texts.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        """The text of each span."""
        return np.repeat(np.arange(self.texts.n), np.diff(self.bounds))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each span's bytes: a polynomial of them, mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.stops - self.starts
        data = self.texts.data
        head, tail = self.starts[0], self.stops[-1]
        gap = np.diff(np.append(self.starts, tail))
        inside = np.arange(head, tail, dtype=np.int64) - np.repeat(self.starts, gap)
        beyond = inside >= np.repeat(lengths, gap)
        inside[beyond] = 0
        terms = powers(int(lengths.max()))[inside]
        terms *= data[head:tail].astype(np.uint64) + np.uint64(1)
        terms[beyond] = 0
        sums = np.add.reduceat(terms, self.starts - head)
        return mix(sums ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def runs_of(values: np.ndarray, size: int, multipliers: np.ndarray) -> np.ndarray:
    """Hash of each `size` neighbours: element i covers values[i : i + size]."""
    n = max(0, len(values) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += values[j : j + n] * multipliers[j]
    return mix(total)


def within(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n run starts have all `size` elements in one text."""
    ok = np.ones(n, bool)
    for back in range(1, size):
        at = bounds[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok
