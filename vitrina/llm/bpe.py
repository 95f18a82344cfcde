"""Operator 8: byte-level BPE encoding and decoding by corpus-level merge replay.

Each Arrow task cuts its texts into pieces, takes the pieces that it has not
seen and encodes them together. The merges of all pieces are replayed in waves:
the ranks of all pairs lie beside their positions in one array, each wave
merges the leftmost of the lowest rank of every piece at once, and only the two
pairs around a merge are looked up again. In long pieces, where that would take
a wave for each merge, an index from the rank of a pair to its positions is
replayed instead, lowest rank first and leftmost first. Pieces are then looked
up.

Null texts are empty; an empty text has no ids. Text of any length works: cost
grows with n log n of the longest piece. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vitrina.llm.texts import blocks

#: Pieces kept per task, and the longest of them in characters; others are encoded again.
CACHE_PIECES, CACHE_CHARS = 300_000, 48
#: Bytes of the longest piece that is replayed in waves.
WAVE_BYTES = 64
#: Stands for the rank of a pair that nothing joins.
_NEVER = 1 << 62


def read_ranks(path: str) -> bytes:
    """The rank file's bytes: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


class Merges:
    """Tokens by rank, and the replay of all merges over many pieces."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # White space as the tokenizer's own library has it: Unicode White_Space.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._joined: dict[tuple[int, int], int] = {}
        # Pieces of the last blocks, and of those before: a full half replaces the other.
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        pairs = (self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256))
        self.byte_pairs = np.fromiter(pairs, np.int64, 65536)
        # Every pair of tokens that forms a token, by both ranks.
        rank = self.rank.get
        joins = [
            (a << 32 | b, whole)
            for token, whole in self.rank.items()
            for k in range(1, len(token))
            if (a := rank(token[:k])) is not None and (b := rank(token[k:])) is not None
        ]
        table = np.array(joins or [(-1, _NEVER)], np.int64)
        self.pair_keys, self.pair_ranks = table[np.argsort(table[:, 0])].T.copy()

    def _merged(self, a: int, b: int) -> int:
        """Rank of the token that a and b form, or -1."""
        found = self._joined.get((a, b))
        if found is None:
            if len(self._joined) > 1_000_000:
                self._joined.clear()
            found = self._joined[a, b] = self.rank.get(self.token[a] + self.token[b], -1)
        return found

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, or _NEVER."""
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def _waves(self, symbol: np.ndarray, at: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> None:
        """Replays, within symbol, the pieces whose positions stand one after the
        other in `at`; pairs has the rank of each with the next. What a merge
        takes away becomes -1."""
        now = symbol[at]
        while len(lengths):
            low = np.minimum.reduceat(pairs, np.cumsum(lengths) - lengths)
            goes_on = low < _NEVER
            if not goes_on.all():
                left = np.repeat(goes_on, lengths)
                at, now, pairs, lengths, low = at[left], now[left], pairs[left], lengths[goes_on], low[goes_on]
                if not len(lengths):
                    return
            count = np.arange(len(lengths))
            lowest = np.flatnonzero(pairs == np.repeat(low, lengths))
            owner = np.repeat(count, lengths)[lowest]
            first = lowest[np.flatnonzero(np.diff(owner, prepend=-1))]  # one in each piece
            now[first] = symbol[at[first]] = low
            symbol[at[first + 1]] = -1
            stays = np.ones(len(at), bool)
            stays[first + 1] = False
            at, now, pairs, lengths = at[stays], now[stays], pairs[stays], lengths - 1
            first -= count
            stops = np.cumsum(lengths)
            pairs[first] = _NEVER
            follows = first < stops - 1
            i = first[follows]
            pairs[i] = self._ranks(now[i], now[i + 1])
            precedes = first > stops - lengths
            i = first[precedes]
            pairs[i - 1] = self._ranks(now[i - 1], now[i])

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        ids, ends = self._replayed(pieces)
        return [part.tolist() for part in np.split(ids, ends[:-1])] if pieces else []

    def _replayed(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where those of each piece end."""
        # A piece that is a token itself stands for one symbol, which nothing joins.
        whole = [self.rank.get(piece, -1) for piece in pieces]
        raw = b"".join([piece if rank < 0 else b"\0" for piece, rank in zip(pieces, whole, strict=True)])
        ends = np.cumsum([len(piece) if rank < 0 else 1 for piece, rank in zip(pieces, whole, strict=True)], dtype=np.int64)
        units = np.frombuffer(raw, np.uint8).astype(np.int64)
        n = len(units)
        if not n:
            return np.zeros(0, "<u4"), ends
        first = self.single[units]
        known = np.array(whole)
        first[ends[known >= 0] - 1] = known[known >= 0]
        follows = np.arange(1, n + 1)
        follows[ends[ends > 0] - 1] = -1
        precedes = np.arange(-1, n - 1)
        precedes[ends[ends < n]] = -1
        precedes[0] = -1
        pairs = np.append(np.where(follows[:-1] >= 0, self.byte_pairs[units[:-1] * 256 + units[1:]], -1), -1)
        lengths = np.diff(ends, prepend=0)
        waves = (lengths > 1) & (lengths <= WAVE_BYTES)
        in_waves = np.repeat(waves, lengths)
        at = np.flatnonzero(in_waves)
        self._waves(first, at, lengths[waves], np.where(pairs[at] < 0, _NEVER, pairs[at]))
        if lengths.max() > WAVE_BYTES:
            first = self._by_index(first, follows, precedes, np.where(in_waves, -1, pairs))
        live = first >= 0
        return first[live].astype("<u4"), np.concatenate([[0], np.cumsum(live)])[ends]

    def _by_index(self, first: np.ndarray, follows: np.ndarray, precedes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """The symbols after the replay of the pairs that have a rank, those that are gone as -1."""
        places = np.flatnonzero(pairs >= 0)
        places = places[np.argsort(pairs[places], kind="stable")]
        ranks, cuts = np.unique(pairs[places], return_index=True)
        queue: list[int] = ranks.tolist()
        index: dict[int, list[int]] = dict(zip(queue, [x.tolist() for x in np.split(places, cuts[1:])], strict=True)) if queue else {}
        symbol: list[int] = first.tolist()
        after: list[int] = follows.tolist()  # the next live position of the same piece, or -1
        before: list[int] = precedes.tolist()
        seen, merged = self._joined.get, self._merged
        while queue:
            rank = heappop(queue)
            places = index.pop(rank, [])
            places.sort()
            for n, i in enumerate(places):
                j = after[i]
                a = symbol[i]
                if a < 0 or j < 0:
                    continue
                b = symbol[j]
                if (found := seen((a, b))) is None:
                    found = merged(a, b)
                if found != rank:
                    continue
                symbol[i], symbol[j] = rank, -1
                after[i] = k = after[j]
                lower = False
                if k >= 0:
                    before[k] = i
                    b = symbol[k]
                    if (new := seen((rank, b))) is None:
                        new = merged(rank, b)
                    if new >= 0:
                        if new not in index:
                            index[new] = []
                            heappush(queue, new)
                        index[new].append(i)
                        lower = new < rank
                if (left := before[i]) >= 0:
                    a = symbol[left]
                    if (new := seen((a, rank))) is None:
                        new = merged(a, rank)
                    if new >= 0:
                        if new not in index:
                            index[new] = []
                            heappush(queue, new)
                        index[new].append(left)
                        lower |= new < rank
                if lower:  # the new pair comes before what is left of this rank
                    if rest := places[n + 1 :]:
                        index.setdefault(rank, []).extend(rest)
                        heappush(queue, rank)
                    break
        return np.array(symbol)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.pieces.findall(text) for text in texts]
        used = set().union(*cut)
        new = used - self.known.keys()
        if self.earlier:
            # What is still in use moves on, so that only the rest is dropped.
            for piece in new & self.earlier.keys():
                self.known[piece] = self.earlier[piece]
            new -= self.known.keys()
        known = self.known
        long = {}
        if new:
            todo = list(new)
            ids, ends = self._replayed([piece.encode() for piece in todo])
            flat, ends = ids.tobytes(), (ends * 4).tolist()
            for piece, start, end in zip(todo, [0, *ends], ends):
                (known if len(piece) <= CACHE_CHARS else long)[piece] = flat[start:end]
        if long:
            known = known | long
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        if len(self.known) > CACHE_PIECES // 2:
            self.earlier, self.known = self.known, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _merges(ranks: bytes, pattern: str) -> Merges:
    return Merges(ranks, pattern)


def _over_texts(docs: DataFrame, text: str, keys: list[str], work, schema: str) -> DataFrame:
    """work(list of texts) gives the columns after the keys, block by block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in blocks(batch, text):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                held = [part.column(part.schema.get_field_index(k)) for k in keys]
                new = work(texts)
                yield pa.RecordBatch.from_arrays(held + list(new.values()), keys + list(new))

    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{types}, {schema}")


def encode(docs: DataFrame, ranks: bytes, pattern: str, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """The keys of each row and `ids`: its tokens, 4 bytes each, little-endian."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        return {"ids": pa.array(_merges(ranks, pattern).encode(texts), pa.binary())}

    return _over_texts(docs, text, keys or ["doc_id"], work, "ids binary")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, keys: list[str] | None = None) -> DataFrame:
    """The keys of each row and `decoded`: the bytes that its `ids` stand for."""
    keys = keys or ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _merges(ranks, pattern)
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            held = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array([table.decode(x or b"") for x in ids], pa.binary())], [*keys, "decoded"]
            )

    types = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keys)
    return encoded.select(*keys, "ids").mapInArrow(run, f"{types}, decoded binary")


def round_trip(
    docs: DataFrame, ranks: bytes, pattern: str, keys: list[str] | None = None, text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Per row: its keys, `n_tokens`, `ids` (unless not asked for), `ids_sha256` and
    `decoded_sha256` (texts are encoded and their ids decoded in one pass)."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        table = _merges(ranks, pattern)
        ids = table.encode(texts)
        shown = {"ids": pa.array(ids, pa.binary())} if with_ids else {}
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            **shown,
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(table.decode(x)).hexdigest() for x in ids], pa.string()),
        }

    schema = f"n_tokens long, {'ids binary, ' * with_ids}ids_sha256 string, decoded_sha256 string"
    return _over_texts(docs, text, keys or ["doc_id"], work, schema)
