"""The R-tree join against all pairs."""

import random

import numpy as np
import pytest
from conftest import WORD

from vitrina.llm import rtree

pytestmark = pytest.mark.usefixtures("sin_codegen")

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    """Least reachable id of each id; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    least = {i: i for i, _ in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return sorted((i, len(shingles(t)), find(i)) for i, t, *_ in rows if i is not None)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


def edited(words, share, random_, names):
    return [random_.choice(names) if random_.random() < share else w for w in words]


@pytest.fixture(scope="module")
def texts():
    """Groups of edited copies around the threshold, long ones too, with a passage that all share."""
    random_ = random.Random(12)
    names = [f"w{i}" for i in range(4000)]
    passage = [random_.choice(names) for _ in range(40)]
    out = []
    for _ in range(12):
        base = [random_.choice(names) for _ in range(random_.choice([7, 30, 150, 700]))]
        base += passage * (random_.random() < 0.5)
        out += [" ".join(edited(base, random_.choice([0, 0.005, 0.01, 0.02, 0.03]), random_, names)) for _ in range(30)]
    out += ["", None, " ", "one two", "ONE  two", "one two three", "a b c d", "A B C D", "a b c d e"]
    random_.shuffle(out)
    return out


@pytest.mark.parametrize("block, common", [(7, 1 << 15), (400, 0)])
def test_jaccard_join(spark, texts, monkeypatch, block, common):
    monkeypatch.setattr(rtree, "BLOCK", block)
    monkeypatch.setattr(rtree, "COMMON", common)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    assert found(rtree.jaccard_join(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_tree_loses_nothing():
    """Every pair that all bounds leave is found, and bounds are no less than the overlap."""
    random_ = np.random.default_rng(5)
    sets = []
    for size in random_.choice([20, 60, 70, 300, 330], 60):
        base = np.sort(random_.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(4):
            keep = base[random_.random(size) > 0.04]
            more = random_.integers(0, 2**63, size - len(keep), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([keep, more])))
    sizes = np.array([len(s) for s in sets])
    vectors = [rtree.vector(rtree.counts(s), len(s)) for s in sets]
    pairs = {tuple(sorted((x, y))) for x, ys in rtree.candidates(vectors, sizes) for y in ys}
    for x in range(len(sets)):
        for y in range(x):
            shared = len(np.intersect1d(sets[x], sets[y]))
            g = min(len(vectors[x]), len(vectors[y]))
            assert np.minimum(rtree.coarser(vectors[x], g), rtree.coarser(vectors[y], g)).sum() >= shared
            if 100 * shared >= 85 * (sizes[x] + sizes[y] - shared):
                assert (y, x) in pairs
    assert len(pairs) < 60 * 30


def test_first_shingles_meet():
    """Sets that share 85 % meet among their first shingles in any order."""
    random_ = np.random.default_rng(6)
    for common in (0, 3, 60):
        for _ in range(200):
            a = np.unique(random_.integers(0, 2**63, random_.integers(1, 120), dtype=np.uint64))
            b = np.unique(np.concatenate([a[random_.random(len(a)) > 0.08], random_.integers(0, 2**63, len(a) // 15, dtype=np.uint64)]))
            table = np.array([(x, i) for i, x in enumerate(np.sort(random_.choice(a, min(common, len(a)), replace=False)).view(np.int64))], np.int64).reshape(-1, 2)
            table = table[np.argsort(table[:, 0].view(np.uint64))]
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(rtree.first_shingles(a, table), rtree.first_shingles(b, table)))


def test_odd_documents(odd, empty, spark):
    rows = [tuple(r) for r in odd.collect()]
    assert found(rtree.jaccard_join(odd)) == brute(rows)
    without_id = [r for r in rtree.jaccard_join(odd).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id) for r in without_id] == [(7, None)]
    assert rtree.jaccard_join(empty).count() == 0


def test_one_id_on_several_texts(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(1, texts[0], "x"), (2, texts[1], "x"), (3, texts[2], "x"), (9, texts[0], "x"), (9, texts[1], "x"), (9, texts[2], "x")]
    rows += [(9, texts[2], "x"), (11, None, None)]
    assert found(rtree.jaccard_join(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
