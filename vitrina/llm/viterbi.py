"""Operator 4: token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists every vocabulary piece in the text; dynamic programming
carries the best score and its number of tokens, and nothing else. Ties go to
the piece that starts first, a character without a piece of its own costs the
lowest score less 10 and counts as its UTF-8 bytes: the rules of the unigram
tokenizers that also give the tokens.

Text is cut where no vocabulary piece can reach over (checked when the
vocabulary is read), so equal stretches are counted once per task. Scores are
whole numbers in the vocabularies used here, so sums are exact.

Null and empty texts have 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from vitrina.llm.texts import blocks

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_STRETCHES, CACHE_CHARS = 400_000, 48


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, control and byte pieces left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        # Cuts: before a space mark that follows another character, and around line ends.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p, _ in pieces)
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if apart else r"(?s:.+)")
        self.known: dict[str, int] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and token count of the best segmentation of a normalised text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)
        at, piece = next(matches, (n, None))
        for end in range(1, n + 1):
            best, tokens, single = float("-inf"), 0, False
            # Of the matches with one end, the longest (the earliest start) comes first.
            while at == end - 1:
                length, value = piece
                if (total := score[end - length] + value) > best:
                    best, tokens = total, count[end - length] + 1
                single |= length == 1
                at, piece = next(matches, (n, None))
            if not single and (total := score[end - 1] + self.unknown) > best:
                best, tokens = total, count[end - 1] + len(text[end - 1].encode())
            score[end], count[end] = best, tokens
        return score[n], count[n]

    def count(self, text: str) -> int:
        """Tokens of a raw text: spaces become marks, one is put in front."""
        if not text:
            return 0
        known, total = self.known, 0
        for stretch in self.stretches.findall(SPACE + text.replace(" ", SPACE)):
            k = known.get(stretch)
            if k is None:
                k = self.best(stretch)[1]
                if len(stretch) <= CACHE_CHARS:
                    if len(known) >= CACHE_STRETCHES:
                        known.clear()
                    known[stretch] = k
            total += k
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, `n_tokens`, and `n_bytes` of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            for part, raw in blocks(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                counts = [counter.count(t or "") for t in texts]
                sizes = raw.offsets[1:] - raw.offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(key)), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                    [key, "n_tokens", "n_bytes"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_bytes long")
