"""Few labels, clashing columns, rows that share an id or have none."""

import pytest
from test_joins import without_repeats

from vitrina.llm import decontamination, minhash, repeats, toxicity, urls

pytestmark = pytest.mark.usefixtures("sin_codegen")


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 1)], [(1, 0), (2, 1), (3, 0), (4, 1)]])
def test_toxicity_with_few_labels(spark, labels):
    """No slot separates the classes: a score all the same, and no crash."""
    docs = spark.createDataFrame([(i, f"some words number {i}") for i in range(6)] + [(7, None), (8, "")], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_margin_is_the_sum_over_pairs():
    import numpy as np

    random = np.random.default_rng(3)
    weight, factor = np.zeros(toxicity.SLOTS), np.zeros((toxicity.SLOTS, toxicity.FACTORS))
    used = random.choice(toxicity.SLOTS, 30, replace=False)
    weight[used], factor[used] = random.normal(size=30), random.normal(size=(30, toxicity.FACTORS))
    machine = toxicity.Machine(0.3, weight, factor)
    rows = [np.sort(random.choice(used, k, replace=False)) for k in (0, 1, 2, 9, 30)]
    found = machine.margin(np.repeat(np.arange(5), [len(r) for r in rows]), np.concatenate(rows), 5)
    for margin, slots in zip(found, rows, strict=True):
        pairs = sum(machine.factor[a] @ machine.factor[b] for i, a in enumerate(slots) for b in slots[:i])
        assert margin == pytest.approx(0.3 + machine.weight[slots].sum() + pairs, rel=1e-4, abs=1e-4)


def test_url_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x", "y", "z")], "page_id long, url string, r string, key string, verdict string")
    rules = spark.createDataFrame([("b", "/", "block")], urls.RULE_SCHEMA)
    (row,) = urls.judge(pages, rules).collect()
    assert (row.r, row.key, row.rule, row.verdict) == ("x", "y", "b/", "block")


def test_repeats_of_one_id_with_several_texts(spark):
    """Each row as if its id were its own, compared with documents of lesser ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    short = " ".join(f"a{i}" for i in range(25))
    texts = [(1, a), (2, b), (5, "x " + a + " y"), (5, short), (5, c), (5, None), (6, c + " " + b), (None, a)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = repeats.remove_repeats(docs).collect()
    found = sorted((r.n_words, r.n_removed, r.kept_text) for r in rows if r.doc_id == 5)
    alone = [without_repeats([a, b, t])[2] for t in ("x " + a + " y", short, c, None)]
    assert found == sorted(alone)
    (last,) = [r for r in rows if r.doc_id == 6]
    assert (last.n_words, last.n_removed, last.kept_text) == (120, 120, "")


def test_near_duplicates_of_an_id_with_three_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, b), (3, c), (9, a), (9, b), (9, c), (4, "other")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert rows == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4)}


def test_a_null_text_does_not_displace_another(spark):
    docs = spark.createDataFrame([(1, None), (1, "a real text of one document"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.one_of_each(docs).collect()), key=str) == [(1, "a real text of one document"), (2, None)]


def test_rows_without_id_are_judged_by_themselves(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, "clean text without any item in it"), (None, "here " + item), (None, None), (3, item), (3, "another text of that id"), (4, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    left = sorted(map(tuple, decontamination.decontaminate(docs, bench).collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
