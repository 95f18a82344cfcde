"""Operator 10: fuzzy line dedup by MinHash, in DataFrame functions only.

Equal lines form a class at once. A class is a set of character shingles: the 12
characters from the start of each word on, up to the end of the second word
after it, and in words of more than 12 characters also every further 12 and the
last 12, so every character is in one (in lines with hardly any space, as in
scripts without, the 9 characters from every place on). Two classes are linked
if their sets share 85 % of their union, and of each component of linked classes
only the first line stays: the one in the document with the least id, there the
first in line order. The sets weigh words alike, so an added short word counts
for less than by the shingles of all places.

* Signature: 40 minima. One hash is taken for each shingle and turned by an
  exclusive or with 40 fixed masks that differ in their top bits, so each mask
  draws from its own part of the hash range and from the next one where that is
  empty.
* Banding: 10 bands of 4 minima. A pair at the threshold misses all of them in
  6 of 10,000 cases, one at 90 % in 2 of 100,000.
* Verification: exact Jaccard of the sets, first of every class with a few hubs of
  its buckets, in turn. In buckets that still hold several components, lines are then
  compared across components, but only those that share one of their rarest
  shingles: two sets over the threshold share one among the rarest 15 % of each,
  ranked high enough in both to leave room for the overlap (prefix and position
  filtering), so this loses no link and needs no cap. Before any comparison a
  pair is bounded by parities: each set has 256 bits, a bit is the parity of the
  shingles that hash to it, and no more bits differ than shingles do.

Lines without a word (see vitrina.llm.texts) always stay and link nothing. Null
texts have no lines. Equal rows count as one document and are treated alike;
rows with one doc_id and different texts are read in the order of a hash of the
text; rows without doc_id count as one document that comes last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrina.llm.components import components
from vitrina.llm.shared import Workspace

SHARED_PERCENT = 85
BANDS, ROWS = 10, 4
#: Words of 64 parity bits of a set.
PARITIES = 4
#: Hubs that each bucket tries, as long as it holds several components.
TURNS = 2

#: Characters of a shingle from the start of a word, and from any place.
FROM_WORD, ANYWHERE = 12, 9
#: A line with fewer words than one in so many characters takes a shingle at every place.
SPARSE = 24

_WORD = r"[^\x20\x09-\x0D]"


def _masks() -> list[int]:
    n = BANDS * ROWS
    return [((j << 64) // n + (1 << 63)) % (1 << 64) - (1 << 63) for j in range(n)]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, version, line_no, line and id (a 128-bit name) of each line with a word."""
    # The hash is taken before the text is cut, so once for each text.
    whole = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return (
        whole.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(_WORD))
        .withColumn("id", F.unhex(F.md5("line")))
    )


def _hashed(lines: DataFrame, *others: str) -> DataFrame:
    """id, the other columns and h, one row for each shingle of a line."""
    words = F.split("line", " ")
    sparse = F.size(words) * SPARSE < F.length("line")
    # Two bytes for each character, so that a shingle is found by its place.
    units = F.when(sparse, F.encode("line", "UTF-16BE"))
    places = F.greatest(F.octet_length(F.encode("line", "UTF-16BE")) / 2 - ANYWHERE + 1, F.lit(1)).cast("int")
    last = F.when(sparse, places).otherwise(F.size(words))
    placed = lines.select("id", *others, words.alias("words"), units.alias("units"), last.alias("last"))
    # What of long words lies beyond their first shingle follows after the words.
    long = F.filter("words", lambda w: F.length(w) > FROM_WORD)
    more = F.when(F.col("units").isNull(), F.flatten(F.transform(long, _further))).otherwise(F.array().cast("array<string>"))
    placed = placed.withColumn("more", more)
    placed = placed.select("id", *others, "words", "units", "more", F.explode(F.sequence(F.lit(1), F.col("last") + F.size("more"))).alias("i"))
    i = F.col("i")
    three = F.concat_ws(" ", F.get("words", i - 1), F.get("words", i), F.get("words", i + 1))
    anywhere = F.xxhash64(F.substring("units", 2 * i - 1, F.lit(2 * ANYWHERE)))
    n = F.size("words")
    of_word = F.when(i > n, F.get("more", i - n - 1)).otherwise(F.left(three, F.lit(FROM_WORD)))
    h = F.when(F.col("units").isNull(), F.xxhash64(of_word)).otherwise(anywhere)
    return placed.select("id", *others, h.alias("h"))


def _further(word: Column) -> Column:
    """Every further 12 characters of a long word, and the last 12."""
    starts = F.sequence(F.lit(FROM_WORD + 1), F.length(word), F.lit(FROM_WORD))
    return F.concat(F.transform(starts, lambda p: F.substring(word, p, F.lit(FROM_WORD))), F.array(F.right(word, F.lit(FROM_WORD))))


def _classes(lines: DataFrame) -> DataFrame:
    """id, copies, first_doc and bands of each distinct line."""
    # The exchange by id serves both aggregations.
    distinct = lines.groupBy("id").agg(F.any_value("line").alias("line"), F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    least = [F.min(F.col("h").bitwiseXOR(F.lit(mask))).alias(f"m{j}") for j, mask in enumerate(_masks())]
    signed = (
        _hashed(distinct, "first_doc", "copies")
        .groupBy("id")
        .agg(F.min("first_doc").alias("first_doc"), F.min("copies").alias("copies"), *least)
    )
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("id", "first_doc", "copies", F.array(*bands).alias("bands"))


def _parities() -> list[Column]:
    """p0 to p3 of a set: its shingles, each at the bit that its hash names, by exclusive or."""

    def word(number: int) -> Column:
        own = F.filter("shingles", lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(PARITIES - 1)) == number)
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(bit(h)))

    return [word(j).alias(f"p{j}") for j in range(PARITIES)]


_BOUNDS = ["n", *[f"p{j}" for j in range(PARITIES)]]


def _may_link(one: Column, other: Column) -> Column:
    """Whether sizes and parities leave room for a link: of n and m shingles two
    linked sets differ in (n + m) * 15 / 185 at most."""
    n, m = one["n"], other["n"]
    differ = reduce(Column.__add__, [F.bit_count(one[p].bitwiseXOR(other[p])) for p in _BOUNDS[1:]])
    like = F.least(n, m) * 100 >= F.greatest(n, m) * SHARED_PERCENT
    return like & (differ * (100 + SHARED_PERCENT) <= (n + m) * (100 - SHARED_PERCENT))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    fits = shared * 100 >= (F.size("s_a") + F.size("s_b") - shared) * SHARED_PERCENT
    return pairs.join(right, "b").join(left, "a").where(fits).select("a", "b")


def _to_hubs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each class and a hub of its bucket that is of another component."""
    hubs = mixed.groupBy("bucket").agg(F.min_by(F.struct("id", "component", *_BOUNDS), F.xxhash64("id", F.lit(turn))).alias("hub"))
    own = F.struct(*_BOUNDS)
    apart = mixed.join(hubs, "bucket").where("component != hub.component").where(_may_link(own, F.col("hub")))
    return apart.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _across(work: Workspace, mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles."""
    open_ = mixed.select("id", "component", *_BOUNDS).distinct()
    shingles = sets.join(open_, "id", "left_semi").select("id", F.explode("shingles").alias("h"))
    number = work.write(shingles.groupBy("h").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1"), "counts")
    ranked = (
        shingles.join(number, "h", "left")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("lines", F.lit(1)).alias("lines"), "h"))).alias("ranked"))
    )
    n = F.size("ranked")
    prefix = F.slice("ranked", F.lit(1), n - F.ceil(n * SHARED_PERCENT / 100).cast("int") + 1)
    # A shingle of one line only brings no line together.
    placed = F.transform(prefix, lambda x, i: F.struct(x["h"].alias("h"), i.alias("rank"), x["lines"].alias("lines")))
    common = F.filter(placed, lambda x: x["lines"] > 1)
    rare = work.write(ranked.select("id", common.alias("rare")), "rare")
    placed = rare.where("size(rare) > 0").join(open_, "id")
    earlier = lambda i: F.transform(F.slice("rare", F.lit(1), i), lambda y: y["h"]).alias("earlier")
    placed = placed.select(
        "id", "component", *_BOUNDS, F.inline(F.transform("rare", lambda x, i: F.struct(x["h"].alias("h"), x["rank"].alias("rank"), earlier(i))))
    )
    several = placed.groupBy("h").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("h")
    placed = work.write(placed.join(several, "h"), "placed")
    other = placed.select("h", *[F.col(c).alias(f"b_{c}") for c in ("id", "component", "rank", "earlier", *_BOUNDS)])
    # What ranks before the rarest common shingle is not shared, so it bounds the rest.
    most = F.least(F.col("n") - F.col("rank"), F.col("b_n") - F.col("b_rank"))
    fits = (
        (F.col("id") < F.col("b_id"))
        & (F.col("component") != F.col("b_component"))
        & (most * (100 + SHARED_PERCENT) >= (F.col("n") + F.col("b_n")) * SHARED_PERCENT)
        & _may_link(F.struct(*_BOUNDS), F.struct(*[F.col(f"b_{c}").alias(c) for c in _BOUNDS]))
        # A pair is taken at the first shingle that both have.
        & ~F.arrays_overlap("earlier", "b_earlier")
    )
    pairs = work.write(placed.join(other, "h").where(fits).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct(), "pairs")
    work.drop(number, rare, placed)
    return pairs


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold more than one."""
    labelled = members.join(parts, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", *_BOUNDS, F.coalesce("component", "id").alias("component")
    )
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    return labelled.join(open_.where("c1 != c2").select("bucket"), "bucket")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version (hash of the text) and gone: the numbers, from 0, of its lines to remove."""
    work = Workspace(docs.sparkSession, "lines")
    lines = _lines(docs, key, text)
    classes = work.write(_classes(lines), "classes")
    spread = classes.select("id", F.explode("bands").alias("bucket"))
    shared = work.write(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets")
    members = work.write(spread.join(shared, "bucket"), "members")
    work.drop(shared)
    texts = lines.select("id", "line").join(members.select("id"), "id", "left_semi").groupBy("id").agg(F.any_value("line").alias("line"))
    sets = _hashed(texts).groupBy("id").agg(F.collect_set("h").alias("shingles"))
    sets = work.write(sets.select("id", "shingles", F.size("shingles").alias("n"), *_parities()), "sets")

    mixed = work.write(members.join(sets.select("id", *_BOUNDS), "id").withColumn("component", F.col("id")), "mixed")
    work.drop(members)
    links = None
    for turn in range(TURNS):
        found = _confirmed(_to_hubs(mixed, turn), sets)
        links = work.write(found if links is None else links.unionByName(found), "links")
        parts = components(work, links)
        # Buckets that hold one component are done with.
        still = work.write(_mixed(mixed.drop("component"), parts), "mixed")
        work.drop(mixed)
        mixed = still
    pairs = _across(work, mixed, sets)
    links = work.write(links.unionByName(_confirmed(pairs, sets)), "links")
    parts = components(work, links)

    labelled = classes.join(parts, F.col("id") == F.col("node"), "left").select(
        "id", "first_doc", "copies", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "id").alias("component")
    )
    repeated = labelled.where("linked or copies > 1")
    owners = repeated.groupBy("component").agg(F.min("first_doc").alias("owner"))
    owned = work.write(repeated.join(owners, "component").select("id", "component", "owner"), "owned")

    found = lines.select("doc", "version", "line_no", "id").join(owned, "id").drop("id").distinct()
    order = W.partitionBy("doc", "component").orderBy("version", "line_no")
    later = found.withColumn("n", F.row_number().over(order)).where("n > 1 or not (doc <=> owner)")
    removed = work.write(later.groupBy("doc", "version").agg(F.collect_list("line_no").alias("gone")), "removed")
    work.drop(owned, classes, sets, mixed, pairs, links)
    return removed


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs with the lines that stay in its text column, and with
    `n_lines` (lines with a word) and `n_removed` in the place of columns of
    those names."""
    removed = removed_lines(docs, key, text)
    renamed = removed.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*kept_columns).join(
        renamed, F.col(key).eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__version")), "left"
    )
    return _remaining(joined, kept_columns, text)


def _remaining(joined: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns with the lines that `__gone` leaves of the text, `n_lines` and `n_removed`."""
    # A column of its own, so that a text is cut once and not again for each line that stays.
    cut = joined.withColumn("__split", F.split(text, "\n"))
    split = F.col("__split")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    worded = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(_WORD))), F.lit(0))
    return cut.select(
        *[F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest).alias(c) if c == text else F.col(c) for c in columns],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(worded).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
