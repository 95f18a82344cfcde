"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
import pytest

from vitrina.llm import collocations
from vitrina.llm.shared import Workspace

pytestmark = pytest.mark.usefixtures("sin_codegen")

SCHEMA = "doc_id long, lang string, text string, score string"


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, lang, text, _ in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    chosen = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, words), a in chosen.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i : i + k])
                longest[inner] = max(longest[inner], a)
    out = []
    for (lang, words), a in chosen.items():
        if 100 * longest[lang, words] >= 80 * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    ranked = []
    for lang, best in groupby(sorted(out), key=lambda r: r[0]):
        ranked += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (_, s, a, p, x, y) in enumerate(best, 1) if i <= top]
    return sorted(ranked)


def found(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Words of uneven frequency with fixed phrases, languages of different size."""
    random_ = random.Random(13)
    names = [f"w{i}" for i in range(60)]
    phrases = [[random_.choice(names) for _ in range(random_.choice([2, 3, 4, 5]))] for _ in range(25)]
    out = []
    for i in range(900):
        words = []
        while len(words) < 40:
            words += random_.choice(phrases) if random_.random() < 0.5 else [names[min(59, int(random_.expovariate(0.08)))]]
            words[-1] += random_.choice(["", "", "", ".", ",", "\n", "\t", ";x"])
        out.append((i, random_.choice(["en", "en", "en", "de", "und", None]), " ".join(words).replace("w1 ", "W1 "), "x"))
    return out


@pytest.mark.parametrize("top, start", [(2000, 4000), (15, 2)])
def test_collocations(spark, rows, monkeypatch, top, start):
    """Also where the frontier settles some languages early and goes on for others."""
    monkeypatch.setattr(collocations, "TOP", top)
    monkeypatch.setattr(collocations, "START", start)
    monkeypatch.setattr(collocations, "_POOL", 5000)
    assert found(collocations.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 30, top)


def test_growth_is_bounded(spark, rows, monkeypatch):
    """With few phrases wanted, most triples are never counted."""
    monkeypatch.setattr(collocations, "TOP", 5)
    monkeypatch.setattr(collocations, "START", 10)
    counted = []
    counts = collocations._phrase_counts

    def watched(docs, size, grows):
        df = counts(docs, size, grows)
        counted.append((size, df.count()))
        return df

    monkeypatch.setattr(collocations, "_phrase_counts", watched)
    english = [r for r in rows if r[1] == "en"]
    assert found(collocations.collocations(spark.createDataFrame(english, SCHEMA))) == brute(english, 30, 5)
    few = sum(n for size, n in counted if size == 3)
    assert 0 < few < 0.7 * counts(spark.createDataFrame(english, "doc_id long, lang string, text string, score string").select("lang", "text"), 3, lambda w: w.together(3)).count()


def test_odd_texts(spark):
    """Nulls, empty and separator-only texts, a very long text, words of any bytes, one word in a row."""
    long = " ".join(f"é{i % 7} 漢{i % 3}" for i in range(40_000))
    rows = [(1, None, None, None), (2, "en", "", "x"), (3, "en", " .,;\n\t", "x"), (4, None, "ab " * 200, "x"), (4, "", "ab " * 200, "x")]
    rows += [(5, "fr", long, "x"), (6, "und", "🙂 a\x1cb\xa0c\x0bx " * 31, "x")]
    assert found(collocations.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 30, 2000)


def test_no_text(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "en", None, "x")], SCHEMA)).count() == 0


def test_phrases_cross_the_shuffle_as_the_pools_left_them(spark, rows):
    """No table of them in Spark on this side of it."""
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    plan = collocations._phrase_counts(docs, 2, lambda w: w.together(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]


def test_texts_come_in_small_batches(spark):
    """While a table is written, and only then."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    work = Workspace(spark, "batches", {name: "2000"})
    docs = spark.createDataFrame([("x" * 100,)] * 400, "text string").coalesce(1)
    found = [r.n for r in work.write(docs.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 400 and max(found) < 100
    assert spark.conf.get(name, None) == before
