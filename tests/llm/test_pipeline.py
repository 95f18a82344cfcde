"""The pipeline against plain versions of its five stages."""

import base64
import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from conftest import WORD
from test_joins import brute_lines, edited, groups, shingles

import corpus_pipeline
from vitrina.llm import bpe, quality
from vitrina.llm.texts import Texts

pytestmark = pytest.mark.usefixtures("sin_codegen")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long"  # n_lines: a name that a stage uses too


@pytest.fixture(scope="module")
def corpus():
    """Prose with junk, lines that many documents share, edited and equal copies,
    passages of test items, short, empty and null texts."""
    random_ = random.Random(21)
    names = [f"word{i}" for i in range(3000)]
    licence = "Released under the licence " + " ".join(f"l{i}" for i in range(20)) + "."
    items = [[f"item{k}x{i}" for i in range(30)] for k in range(6)]

    def prose():
        return [[random_.choice(names) for _ in range(random_.randrange(20, 40))] for _ in range(random_.randrange(4, 8))]

    texts = []
    for d in range(160):
        body = prose()
        if d % 9 == 0:
            body.insert(random_.randrange(len(body)), items[d % 6][: 30 if d % 2 else 26])
        rows = [" ".join(line) + "." for line in body]
        if d % 4 == 0:
            rows.append(licence)
        texts.append("\n".join(rows))
        if d % 8 == 1:
            texts.append(texts[-1])  # equal: all its lines go
        if d % 8 == 2:  # one long line a copy, edited so that the line differs and the text does not
            line = " ".join(w for row in body for w in row)
            texts += ["\n".join([line, "a note"]), " ".join(edited(line.split(), 0.02, random_, names)) + " more " * 3]
        if d % 8 == 3:
            texts.append(" ".join(random_.choice(["buy", "$$$", "###", "NOW!!"]) for _ in range(80)))
    texts += [None, "", "short text", "again and again " * 40]
    labels = [(i, int("$$$" not in (t or "$$$")), 0) for i, t in enumerate(texts) if i % 2]
    return texts, labels, [(k, " ".join(words)) for k, words in enumerate(items)]


def judged_by_hand(trees, texts):
    """The verdict of the trees, node by node, and of the base rule."""
    base, features = quality.statistics(Texts(pa.array(texts, pa.string())))
    kept = []
    for i, x in enumerate(features):
        margin = trees.start
        for feature, cut, left, value in zip(trees.feature, trees.cut, trees.left, trees.value, strict=True):
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(x[feature[node]] > cut[node])
            margin += value[node]
        failed = base["n_words"][i] < 50 or 100 * base["n_repeat_words"][i] > 50 * base["n_words"][i]
        kept.append(bool(not failed and 1 / (1 + np.exp(-margin)) >= 0.3))
    return kept


def holds(text, item):
    """Smith-Waterman over the whole text, one point a word, half a point off for a change."""
    a, b = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()) for t in (item, text))
    above, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (1 if x == y else -0.5), above[j + 1] - 0.5, row[-1] - 0.5))
        best, above = max(best, *row), row
    return best >= 0.5 * len(a)


def by_hand(trees, texts, items):
    docs = [(i, t) for (i, t), k in zip(enumerate(texts), judged_by_hand(trees, texts), strict=True) if k]
    steps = [{i for i, _ in docs}]
    cut = brute_lines([t for _, t in docs])
    docs = [(i, t) for (i, _), t in zip(docs, cut, strict=True) if WORD.search(t)]
    steps.append({i for i, _ in docs})
    sets = [shingles(t) for _, t in docs]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = groups(pairs, range(len(docs)))
    docs = [d for k, d in enumerate(docs) if component[k] == k]
    steps.append({i for i, _ in docs})
    docs = [(i, t) for i, t in docs if not any(holds(t, item) for _, item in items)]
    return docs, [*steps, {i for i, _ in docs}]


def test_pipeline(spark, tmp_path, corpus):
    texts, labels, items = corpus
    rows = [(i, t, "en", "s", len(t) if t is not None else None, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels")}
    docs, steps = by_hand(quality.train(tables["documents"], tables["labels"]), texts, items)
    sizes = [len(texts), *map(len, steps)]
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)) and docs, "each stage has something to remove"

    raw = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, text in docs:
        ids = reference.encode_ordinary(text)
        expected[i] = (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected


def test_stages_keep_the_columns(spark, tmp_path, corpus):
    texts, labels, items = corpus
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1) for i, t in enumerate(texts[:40])], SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
