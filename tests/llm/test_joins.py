"""Operators that compare rows, against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from vitrina.llm import decontamination, lines, minhash, repeats, urls
from vitrina.llm.components import components
from vitrina.llm.shared import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(words, share, random_, names):
    return [random_.choice(names) if random_.random() < share else w for w in words]


@pytest.fixture(scope="module")
def variants(spark):
    """Groups of edited copies around the threshold, equal copies, short and empty texts."""
    random_ = random.Random(4)
    names = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(12):
        base = [random_.choice(names) for _ in range(random_.choice([8, 60, 200]))]
        texts += [" ".join(edited(base, random_.choice([0, 0.01, 0.03, 0.05]), random_, names)) for _ in range(25)]
    texts += ["", None, " ", "one two", "ONE  two", "one two three", "a b c d e", "A B C D E"]
    random_.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


# --- components --------------------------------------------------------------------


def test_components(spark):
    random_ = random.Random(1)
    pairs = [(random_.randrange(300), random_.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    found = components(Workspace(spark, "t"), spark.createDataFrame(pairs, "a long, b long"))
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert {r.node: r.component for r in found.collect()} == groups(pairs, nodes)
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 near-duplicates -----------------------------------------------------------------


def shingles(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(variants):
    docs, texts = variants
    sets = [shingles(t) for t in texts]
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    component = groups(pairs, range(len(sets)))
    rows = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(sets[i]), component[i], component[i] == i) for i in range(len(sets))
    }


def test_blocks_of_a_bucket_lose_no_pair(variants, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_near_duplicates(variants)


def test_estimate_is_corrected_for_chance():
    random_ = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.9):
        a = random_.integers(0, 2**63, 2000).astype(np.uint64)
        b = np.where(random_.random(2000) < 2 * share / (1 + share), a, random_.integers(0, 2**63, 2000).astype(np.uint64))
        packed = minhash._packed(np.array([minhash.minima(np.sort(x)) for x in (a, b)]))
        assert abs(minhash.estimate(packed[0], packed[1:])[0] - share) < 0.15


def test_near_duplicates_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert {r.doc_id: (r.component_id, r.kept) for r in rows} == {
        1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), None: (None, True), 5: (5, True), 6: (5, False), 7: (7, True),
    }
    one = minhash.one_of_each(odd)
    assert one.columns == odd.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert minhash.near_duplicates(empty).count() == 0


def test_rows_of_one_document_link_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (3, a), (3, b), (4, c)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 4}


# --- 9 repeats ------------------------------------------------------------------------------


def without_repeats(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen, out = set(), []
    for ws in words:
        gone = set()
        for i in range(len(ws) - 19):
            window = tuple(ws[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def test_repeats(spark):
    random_ = random.Random(6)
    names = [f"w{i}" for i in range(40)]
    passages = [[random_.choice(names) for _ in range(random_.choice([19, 20, 21, 35, 80]))] for _ in range(12)]
    texts = [None, "", "a " * 60, "a " * 25 + "b", " ".join(["a", "b"] * 40), "x " + "a " * 21]
    for _ in range(120):
        parts = [random_.choice(passages) if random_.random() < 0.4 else [random_.choice(names) for _ in range(random_.randrange(30))] for _ in range(6)]
        texts.append(" \n".join(w for p in parts for w in p) + random_.choice(["", " ", "\n"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(docs).collect()}
    assert rows == dict(enumerate(without_repeats(texts)))


def test_repeats_odd_rows(odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == 9
    found = {r.doc_id: (r.n_words, r.n_removed) for r in rows}
    assert found[1] == found[2] == found[3] == (0, 0) and found[4] == (1, 0) and found[None] == (10, 0)
    assert found[5][1] == 0 and found[6] == (12000, 12000)
    assert repeats.remove_repeats(empty).count() == 0


# --- 10 lines ---------------------------------------------------------------------------------


def line_set(line):
    words = line.split(" ")
    if len(words) * lines.SPARSE < len(line):
        return {line[i : i + lines.ANYWHERE] for i in range(max(len(line) - lines.ANYWHERE + 1, 1))}
    return {" ".join(words[i : i + 3])[: lines.FROM_WORD] for i in range(len(words))}


def brute_lines(texts):
    split = [t.split("\n") if t is not None else [] for t in texts]
    distinct = sorted({x for ls in split for x in ls if WORD.search(x)})
    sets = [line_set(x) for x in distinct]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    component = groups(pairs, range(len(sets)))
    number, seen, out = {x: i for i, x in enumerate(distinct)}, set(), []
    for text, ls in zip(texts, split, strict=True):
        kept = []
        for line in ls:
            c = component[number[line]] if line in number else None
            if c is None or c not in seen:
                kept.append(line)
            seen.add(c)
        out.append(None if text is None else "\n".join(kept))
    return out


def test_line_dedup(spark):
    random_ = random.Random(8)
    names = [f"word{i}" for i in range(500)]
    bases = [[random_.choice(names) for _ in range(random_.choice([3, 12, 40, 90]))] for _ in range(30)]
    pool = [" ".join(edited(b, random_.choice([0, 0.01, 0.03]), random_, names)) for b in bases for _ in range(12)]
    pool += ["", "  ", "漢字" * 60, "漢字" * 59 + "字", "no-space-" * 40, "Of.", "Of the."]
    texts = [None, ""] + ["\n".join(random_.choice(pool) for _ in range(random_.randrange(1, 9))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string")
    rows = lines.dedup(docs)
    assert rows.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in rows.collect()} == dict(enumerate(brute_lines(texts)))


def test_ends_of_long_words_keep_lines_apart(spark):
    """Against sets that are not cut: 9 characters from every place."""
    pool = [f"Source: https://www.example.com/item/{'abcdefghij'[i] * 9}" for i in range(10)]
    pool += ["electroencephalograph", "electroencephalogenic", "key-of-the-table-0001", "key-of-the-table-2222"]
    pool += ["\U0001f642" * 40 + x * 30 for x in "xy"]

    def places(line):
        units = line.encode("utf-16-be")
        return {units[2 * i : 2 * i + 18] for i in range(max(len(units) // 2 - 8, 1))}

    sets = [places(x) for x in pool]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    component = groups(pairs, range(len(pool)))
    docs = spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup(docs).collect()} == {i: int(component[i] != i) for i in range(len(pool))}


def test_line_dedup_odd_rows(odd, empty):
    rows = lines.dedup(odd).collect()
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in rows}
    assert len(rows) == 9 and found[4] == (1, 0) and found[1] == found[2] == found[3] == (0, 0)
    assert found[5] == (1, 0) and found[6] == (1, 1) and found[None] == (1, 0)
    assert lines.dedup(empty).count() == 0


def test_texts_are_cut_into_lines_once(spark):
    rows = [(1, "a\nb\n \na\n", [1, 3]), (2, "a\n\nb", None), (3, None, None), (4, "a", [0]), (5, "", None)]
    left = lines._remaining(spark.createDataFrame(rows, "doc_id long, text string, __gone array<int>"), ["doc_id", "text"], "text")
    expected = [(1, "a\n \n", 3, 2), (2, "a\n\nb", 2, 0), (3, None, 0, 0), (4, "", 1, 1), (5, "", 0, 0)]
    assert sorted(map(tuple, left.collect())) == expected
    assert left._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_line_dedup_is_native(odd):
    plan = lines._classes(lines._lines(odd, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


# --- 1 decontamination -----------------------------------------------------------------------------


def test_alignment():
    random_ = np.random.default_rng(0)
    for _ in range(100):
        a, b = (random_.integers(0, 6, random_.integers(0, 20)).astype(np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        score, first, last = decontamination.align(a, b)
        assert score == pytest.approx(h.max())
        assert decontamination.align(a, b[first:last])[0] == pytest.approx(score)


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_edited_items_are_found_and_others_are_not(spark, monkeypatch, block):
    """Exact, re-cased and edited copies, one item in a third of all documents."""
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", block)
    random_ = random.Random(9)
    names = [f"w{i}" for i in range(800)] + ["the", "of", "and"] * 60
    items = [[random_.choice(names) for _ in range(random_.randrange(16, 50))] for _ in range(40)]
    docs, planted = [], set()
    for d in range(300):
        words = [random_.choice(names) for _ in range(random_.randrange(50, 300))]
        if d % 3 == 0 or d % 10 == 1:
            k = 0 if d % 3 == 0 else random_.randrange(1, 40)
            copy = edited(items[k], 0.1 if d % 2 else 0, random_, names)
            at = random_.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in copy] if d % 4 == 0 else copy
            planted.add((d, k))
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, "the of"), (99, None)], "item_id int, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontamination.contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted and all(0.5 <= r.score <= 1 for r in rows)
    left = {r.doc_id for r in decontamination.decontaminate(table, bench).collect()}
    assert left == set(range(300)) - {d for d, _ in planted}


@pytest.mark.parametrize("copies", [5, 25, 1000])
@pytest.mark.parametrize("every", [4, 7])
def test_one_edited_copy_is_found_however_often_it_stands(spark, copies, every):
    """The same edit in each copy, next to one intact copy."""
    item = [f"w{i}" for i in range(40)]
    copy = [f"x{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    texts = [f"a{d} b{d} " + " ".join(copy) + f" c{d}" for d in range(copies)] + [" ".join(item)]
    texts += [f"w0 w1 w2 d{i}" for i in range(2000)]  # common speech
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench).collect()} == set(range(copies + 1))


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a text without id that has"), (2, ""), (3, None)], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(odd, bench).collect()] == [(None, 1)]
    assert decontamination.decontaminate(odd, bench).count() == 8
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


# --- 5 URL filters -----------------------------------------------------------------------------------


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=(None, None, "allow"))
    return host, path, best[0] + best[1] if best[0] is not None else None, best[2]


def test_urls(spark):
    random_ = random.Random(7)
    hosts = [".".join(random_.choice("abc") for _ in range(random_.randrange(1, 5))) for _ in range(40)]
    paths = ["", "/", "/a/", "/a/b", "/a/b/", "/b", "/ab"]
    rules = sorted({(random_.choice(hosts), random_.choice(paths[1:])): random_.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, f"http://{random_.choice(hosts).upper()}{random_.choice(paths)}{random_.choice(['', 'x', '?q=/a/', '#f'])}", "r") for i in range(400)]
    pages += [(400, None, "r"), (401, "no scheme", "r"), (402, "://", "r"), (403, "x://a.b.://c", "r"), (404, "http://c", "r"), (404, "http://c", "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string")
    rows = urls.judge(df, spark.createDataFrame(rules, urls.RULE_SCHEMA)).collect()
    expected = sorted((i, *judged(u, rules)) for i, u, _ in pages)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str) == sorted(expected, key=str)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], urls.RULE_SCHEMA)
    assert [(r.rule, r.verdict) for r in urls.judge(pages, none).collect()] == [(None, "allow")]
    assert urls.judge(pages.limit(0), spark.createDataFrame([("b", "/", "block")], urls.RULE_SCHEMA)).count() == 0
