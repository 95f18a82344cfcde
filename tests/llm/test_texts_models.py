"""Operators that judge, count, encode or read each row by itself."""

import base64
import collections
import hashlib
import html as entities
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from vitrina.llm import bpe, html, quality, toxicity, viterbi
from vitrina.llm.texts import Texts, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a\n\na\n a\n", "x y z x y z x", "a a a a", "\x0b a\x1cb é\n é", "'s 're it's ''s", "🙂 漢字 123 ½ \xa0x", "<|endoftext|>", "ab" * 3000]


@pytest.fixture(scope="module")
def texts(spark, datos):
    return [r.text for r in spark.read.parquet(f"{datos}/documents.parquet").orderBy("doc_id").limit(150).collect()] + ODD


# --- base helpers ---------------------------------------------------------------------


def test_words_and_lines(texts):
    found = Texts(pa.array(texts, pa.string()))
    words, lines = found.words(), found.lines()
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        a, z = words.bounds[i], words.bounds[i + 1]
        got = [found.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:z], words.stops[a:z], strict=True)]
        assert got == WORD.findall(text or "")
        a, z = lines.bounds[i], lines.bounds[i + 1]
        assert [found.data[s:e].tobytes() for s, e in zip(lines.starts[a:z], lines.stops[a:z], strict=True)] == [x for x in raw.split(b"\n") if x]
    by_hash = collections.defaultdict(set)
    for h, s, e in zip(words.hashes(), words.starts, words.stops, strict=True):
        by_hash[int(h)].add(found.data[s:e].tobytes())
    assert all(len(x) == 1 for x in by_hash.values())


def test_blocks_cover_the_batch(texts):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    parts = list(blocks(batch, "text", 1000))
    assert [t for part, _ in parts for t in part.column(0).to_pylist()] == texts and len(parts) > 5


# --- 6 quality --------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(texts):
    base, _ = quality.statistics(Texts(pa.array(texts, pa.string())))
    assert list(zip(*[v.tolist() for v in base.values()], strict=True)) == [counts(t) for t in texts]


def test_trees_are_monotonic_and_learn():
    random_ = np.random.default_rng(1)
    x = random_.random((3000, 3))
    y = (x[:, 0] + 0.3 * random_.random(3000) < 0.6).astype(float)
    trees = quality.fit(x, y, direction=(-1, 0, 1), rounds=20)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85
    probe = np.tile(random_.random((50, 1, 3)), (1, 40, 1))
    probe[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(trees.margin(probe.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-9).all()


def test_quality_on_held_out_rows(spark, datos):
    larger = datos.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    trees = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge(docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    passing = {r.doc_id for r in quality.passing(docs, trees).collect()}
    assert passing == {r.doc_id for r in quality.judge(docs, trees).where("kept").collect()}


def test_quality_odd_rows(spark, odd, empty, datos):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    trees = quality.train(odd, labels)  # nothing to learn from: the base rule alone
    rows = quality.judge(odd, trees).collect()
    assert len(rows) == 9 and all(r.base_failed and not r.kept for r in rows if r.doc_id not in (5, 6))
    assert quality.judge(empty, trees).count() == 0
    assert quality.passing(odd, trees).columns == odd.columns


# --- 3 toxicity ---------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    """An insult alone is harmless here; together with a group it is not."""
    random_ = random.Random(5)
    rows = []
    for i in range(1500):
        words = [f"w{random_.randrange(400)}" for _ in range(20)]
        insult, group = random_.random() < 0.5, random_.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        random_.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(data.select("doc_id", "text"), data.where("doc_id % 3 <> 1").select("doc_id", "toxic"))
    held = toxicity.score(data, machine).join(data.select("doc_id", "toxic"), "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([(r.score > 0.5) == r.toxic for r in held]) > 0.95
    assert np.abs(machine.factor).max() > 0.1  # the pair carries weight of its own


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(odd, labels)
    rows = toxicity.score(odd, machine).collect()
    assert len(rows) == 9 and all(0 <= r.score < 0.01 and r.predicted == 0 for r in rows)
    assert toxicity.score(empty, machine).count() == 0


# --- 4 token counts --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return viterbi.read_vocabulary(P.path("piece_bpe_32k.model"))


def test_counts_are_the_tokenizers(texts, vocabulary):
    least = min(s for _, s in vocabulary)
    whole = [("<unk>", 0.0), *((f"<0x{b:02X}>", least) for b in range(256)), *vocabulary]
    reference = Tokenizer(models.Unigram(whole, 0, True))
    counter = viterbi.Counter(vocabulary)
    for text in texts:
        marked = (viterbi.SPACE + text).replace(" ", viterbi.SPACE) if text else ""
        assert counter.count(text or "") == (len(reference.encode(marked).ids) if text else 0)


def test_counts_where_pieces_cross_spaces():
    """A vocabulary whose pieces reach over spaces is not cut at them; ties go to the earlier start."""
    counter = viterbi.Counter([("▁a▁b", -1.0), ("▁a", -1.0), ("▁b", -1.0), ("b", -0.5), ("▁", -0.5), ("ab", -2.0), ("a", -1.0)])
    assert counter.count("a b") == 1 and counter.count("b") == 1 and counter.count("") == 0
    assert counter.count("é") == 1 + 2


def test_counts_odd_rows(odd, empty, vocabulary):
    rows = viterbi.count_tokens(odd, vocabulary).collect()
    assert len(rows) == 9 and {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert viterbi.count_tokens(empty, vocabulary).count() == 0


# --- 8 byte-level BPE ---------------------------------------------------------------------------


def test_ids_are_the_tokenizers(texts):
    raw = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bpe.Merges(raw, P.PATTERN)
    random_ = random.Random(2)
    noise = ["".join(chr(random_.choice([random_.randint(1, 0x2FF), random_.randint(0x2000, 0xD000)])) for _ in range(80)) for _ in range(60)]
    for text in [t or "" for t in texts] + noise:
        (ids,) = merges.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert merges.decode(ids) == text.encode()


def test_a_lower_rank_that_a_merge_creates_comes_next():
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cd"]
    ranks = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    merges = bpe.Merges(ranks, P.PATTERN)
    for text in ("abc", "abcd", "bcabcabcd", "aabcbccd", "abcabc"):
        assert np.frombuffer(merges.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_pieces_in_use_are_replayed_once(monkeypatch):
    """A full cache drops what was not used lately; common pieces are kept."""
    monkeypatch.setattr(bpe, "CACHE_PIECES", 8)
    merges, replayed = bpe.Merges(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), []
    common, replay = " qwzxjkv", merges._replayed
    monkeypatch.setattr(merges, "_replayed", lambda pieces: replayed.extend(pieces) or replay(pieces))
    texts = [common + "".join(f" xq{chr(97 + k)}{chr(97 + i)}zj" for i in range(6)) for k in range(12)]
    ids = [merges.encode([text])[0] for text in texts]
    assert [merges.decode(x).decode() for x in ids] == texts and replayed.count(common.encode()) == 1
    assert len(merges.known) + len(merges.earlier) <= 16


def test_short_pieces_are_replayed_together(monkeypatch):
    """In waves over all of them, without a queue for each merge; long ones by the index; both alike."""
    raw = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    merges, indexed, random_ = bpe.Merges(raw, P.PATTERN), [], random.Random(5)
    monkeypatch.setattr(bpe, "heappop", lambda queue, pop=bpe.heappop: indexed.append(1) or pop(queue))
    short = ["".join(random_.choices("etaoinshrdlé", k=random_.randint(1, 30))).encode() for _ in range(3000)] + [b"a" * 60, b"-" * 64, b""]
    together = merges.replay(short)
    assert not indexed
    long = [b"".join(short[i : i + 9]) for i in range(0, 200, 9)] + [b"a" * 65]
    mixed = merges.replay([*short[:500], *long, *short[500:]])
    assert indexed and mixed[:500] + mixed[500 + len(long) :] == together
    monkeypatch.setattr(bpe, "WAVE_BYTES", 1)
    assert merges.replay(short) == together
    monkeypatch.setattr(bpe, "WAVE_BYTES", 1000)
    assert merges.replay(long) == mixed[500 : 500 + len(long)]


def test_replay_of_odd_pieces():
    merges = bpe.Merges(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    pieces = [b"", b"the", b"", b"\0", b"qq", bytes(range(256)), b""]
    together = merges.replay(pieces)
    assert together == [merges.replay([piece])[0] for piece in pieces] and together[0] == together[-1] == []
    assert [b"".join(merges.token[i] for i in ids) for ids in together] == pieces and merges.replay([]) == []


def test_round_trip_rows(odd, empty):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    rows = bpe.round_trip(odd, ranks, P.PATTERN).collect()
    source = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == 9
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() and r.n_tokens == len(r.ids) // 4
    assert bpe.round_trip(empty, ranks, P.PATTERN).count() == 0
    decoded = bpe.decode(bpe.encode(odd, ranks, P.PATTERN), ranks, P.PATTERN).collect()
    assert all(bytes(r.decoded) == source[r.doc_id].encode() for r in decoded)


# --- 7 HTML ----------------------------------------------------------------------------------------


def test_main_text_of_given_pages(spark, datos):
    for row in html.extract(spark.read.parquet(f"{datos}/pages.parquet"), ("page_id", "url", "html")).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", row.html, re.S)[1]
        parts = (re.sub(r"<[^>]*>", lambda m: " " if "br" in m[0] else "", b) for b in re.split(r"</?(?:p|h1)>", body))
        blocks_ = (" ".join(entities.unescape(b).split()) for b in parts)
        assert row.text == "\n".join(b for b in blocks_ if b) and row.n_chars == len(row.text)


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body>
<header class=top><a href=/>Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="content"><h2>Title &amp; more</h2><p>First   paragraph of the &lt;story&gt;, which is long enough to count.<div class="ad">Buy now</div>
<p>Second <b>bold</b><i>er</i> words in a line that goes on and on<br>and after a break.<ul><li>one item<li>two</ul>
<form>Name <input> <button>Send</button></form></div>
<aside>Related things</aside><section class="comments"><p>Nice post! I liked it very much, thank you for writing it.</p></section>
<script>var a="<p>no</p>";</script><footer>Copyright</footer></body></html>"""


def test_main_text_without_an_article_element():
    assert html.main_text(PAGE) == "\n".join(
        [
            "Title & more",
            "First paragraph of the <story>, which is long enough to count.",
            "Second bolder words in a line that goes on and on and after a break.",
            "one item",
            "two",
        ]
    )


def test_main_text_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>cut <b>off"), (4, "u", "plain text"), (None, "u", "<script>x"), (5, "u", "<article>" + "<div>" * 3000 + "deep")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in found] == ["", "", "cut off", "plain text", "", "deep"]


LONG = "A sentence of the story that is long enough to stand for its content, as stories are."
STORY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
TOLD = "\n".join(["Title", LONG, LONG, LONG])


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-comments", "page-sidebar-left", "with-nav"])
@pytest.mark.parametrize("inner", ["div", "article", "main"])
def test_wrapper_of_the_page_is_spared(name, inner):
    page = f'<body><div class="{name}"><{inner}>{STORY}</{inner}><div class="sidebar"><p>Latest posts of all</p></div></div></body>'
    assert html.main_text(page) == TOLD


def test_form_round_the_page_is_spared():
    assert html.main_text(f'<body><form id="f">{STORY}<form class="search"><p>Search</p></form></form></body>').startswith(TOLD)
    assert html.main_text(f"<body><div>{STORY}</div><form><p>Your name</p></form></body>") == TOLD


def test_teasers_in_articles_do_not_displace_the_text():
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Read on, there is more to it.</p></article>" for i in range(3))
    assert TOLD in html.main_text(f"<body><div>{STORY}</div><div>{teasers}</div></body>")


def test_header_of_an_article_stays():
    page = f'<body><article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></body>'
    assert html.main_text(page) == TOLD
    assert html.main_text(page.replace("article>", "div>")) == TOLD


def test_long_comments_are_no_wrapper():
    comments = f"<p>{LONG} {LONG}</p>" * 9
    assert html.main_text(f'<body><div>{STORY}</div><div class="comments">{comments}</div></body>') == TOLD
