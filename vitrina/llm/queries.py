"""The operators as queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import bpe, collocations, decontamination, html, lines, minhash, quality, repeats, rtree, toxicity, tries, urls, viterbi

# The rules that the query over pages applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package also where only the driver's path has it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    machine = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = viterbi.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, urls.RULE_SCHEMA)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.jaccard_join(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op5_url_filters": """
WITH r(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
s AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
h AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
      FROM s),
m AS (SELECT h.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
      GROUP BY h.n)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (n)
""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
h AS (SELECT s.doc_id, s.i, array_to_string(w.ws[s.i:s.i + 19], ' ') AS x FROM s JOIN w USING (doc_id)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM o WHERE n > 1),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
r AS (SELECT t.doc_id, count(*) FILTER (g.k IS NOT NULL) AS n_removed,
        string_agg(t.word, ' ' ORDER BY t.k) FILTER (g.k IS NULL) AS kept
      FROM t LEFT JOIN g USING (doc_id, k) GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""",
    "op11_conversation_trie": r"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, count(*) AS total, conv_id - conv_id % 100 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: unicode(s)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM o GROUP BY conv_id),
k AS (SELECT t.*, least(t.h, coalesce(b.total, 0)) AS k FROM t LEFT JOIN t AS b ON b.conv_id = t.base),
r AS (SELECT k.conv_id, o.p AS d, o.role, o.text FROM k JOIN o ON o.conv_id = k.base AND o.p <= k.h
  UNION ALL SELECT k.conv_id, k.k + o.p - k.h, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.p > k.h),
s AS (SELECT conv_id, d, length(text) AS chars,
    string_agg(md5(length(role) || ' ' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
    d = max(d) OVER (PARTITION BY conv_id) AS last FROM r
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM k),
n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM s GROUP BY d, path),
c AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
u AS (SELECT substr(path, 1, 32 * a) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT path, n_children, n_convs, chars, unnest(range(0, d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u USING (path) LEFT JOIN v AS p ON v.d > 0 AND p.path = substr(v.path, 1, 32 * (v.d - 1))
""",
    "op12_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, len(phrase) AS k, array_to_string(phrase, ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, unnest(list_concat(
              list_transform(range(1, len(ws) + 1), lambda i: ws[i:i]), list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]),
              list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]), list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]))) AS phrase FROM w)
      GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30),
s AS (SELECT c.*, i, x.f AS l, y.f AS r, 2000000 * c.a::HUGEINT // (x.f + y.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS i FROM c) AS c
      JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:i], ' ')
      JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[i + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
h AS (SELECT lang, inner_phrase AS phrase, max(a) AS longer FROM (
      SELECT lang, a, unnest(list_concat(
        CASE WHEN k >= 3 THEN list_transform(range(1, k), lambda i: array_to_string(ws[i:i + 1], ' ')) ELSE [] END,
        CASE WHEN k = 4 THEN list_transform(range(1, 3), lambda i: array_to_string(ws[i:i + 2], ' ')) ELSE [] END)) AS inner_phrase FROM c)
      GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN h USING (lang, phrase) WHERE NOT coalesce(100 * longer::HUGEINT >= 80 * a, false))
SELECT lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
""",
}
