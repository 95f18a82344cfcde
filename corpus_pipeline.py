"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet to the shared folder and reads it again as the next stage's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import bpe, decontamination, lines, minhash, quality
from vitrina.llm.queries import table
from vitrina.llm.shared import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the trees reject."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, trees)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are kept elsewhere; those of which no line with a word is left go."""
    kept = lines.dedup(docs).where("n_lines > n_removed")
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (4 bytes each) and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: The trees' verdict and the tokenizer can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, work.write(stage(spark, docs, sf_dir), name)
        work.drop(before)  # a stage's table goes once the next has read it; the given documents stay
    return docs
