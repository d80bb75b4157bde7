"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

1. The benchmark's windows (13 words; a shorter item is one window) and its vocabulary.
2. One pass over the corpus counts the vocabulary's terms; each window takes its ANCHORS
   rarest terms, each at its first offset.
3. A second pass stores the index: postings (row, term, position) of those terms, as 64-bit hashes of the
   terms. It holds no text and no other words.
4. Lists are intersected from the rarest term on: every posting of a window's rarest term gives a start
   (position minus offset), and a start stays only if the list of the next term holds the place start plus that
   term's offset. Lists meet by (row, term, position), so no frequent term is a key of its own.
5. What survives all lists is compared with the texts' own words; these are read again
   for those texts alone. ``phrases`` returns exact occurrences, ``proximity`` the rows where
   an item's rarest terms stand within a span of words.

Texts aren't shuffled while what survives is small enough to be broadcast; tables made from the benchmark are
broadcast only while their number of rows, counted, is at most MOST_SENT.

Defined cases: null and empty texts have no words; items without words or id have no
windows; repeated item ids count once; repeated documents are judged one by one;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import grams as G

#: Words in a window; rows up to which a table is broadcast; rarest terms whose lists are intersected.
WINDOW, MOST_SENT, ANCHORS = 13, 500_000, 3
#: Proximity: an item's so many rarest terms, all within so many words of the rarest.
NEAR_TERMS, SPAN = 3, 50


def item_words(items: DataFrame) -> DataFrame:
    """item (id as string), w: of items with an id and words."""
    return items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), C.words(F.col("text")).alias("w")).where(F.size("w") > 0)


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored: (wid, words) of each distinct window, and (wid, item) of the items that hold it."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    held = item_words(items).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()
    wins = C.written(held.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    return wins, C.written(held.join(wins, "words").select("wid", "item"), "decontam-members")


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """Broadcast a table if its number of rows, counted, allows it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def named(term: Column) -> Column:
    return F.xxhash64(term)


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, n: occurrences in all of ``docs`` of the vocabulary's terms; counted before any join."""
    bits = G.bit_table_of(vocabulary, named(F.col("term")))
    seen = docs.select(F.explode(F.filter(C.words(F.col("text")), lambda w: G.may_hold(bits, named(w)))).alias("term"))
    return seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(small(vocabulary), "term", "left_semi")


def rarest(terms: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """key, rank, t, offset: of (key, term, offset) the ``most`` rarest distinct terms of each key, rank 0 the rarest."""
    n = terms.groupBy(key, "term").agg(F.min("offset").alias("offset")).join(small(counts), "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")))  # a window's or an item's own terms
    best = n.groupBy(key).agg(F.slice(order, 1, most).alias("best"))
    return best.select(key, F.posexplode("best").alias("rank", "b")).select(key, "rank", named(F.col("b.term")).alias("t"), "b.offset")


def index(docs: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The stored index of every row: row, the kept columns, n_words, h1 and h2 (the text's name), posts (t, pos)."""
    bits = G.bit_table_of(terms, F.col("t"))
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.xxhash64(F.lit(0), text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), C.words(F.col("text")).alias("w"))
    posts = F.filter(F.transform("w", lambda w, i: F.struct(named(w).alias("t"), i.alias("pos"))), lambda p: G.may_hold(bits, p["t"]))
    return C.written(split.select("row", *keep, F.size("w").alias("n_words"), "h1", "h2", posts.alias("posts")), "decontam-index")


def lists(stored: DataFrame) -> DataFrame:
    """row, t, pos of every posting."""
    return stored.select("row", F.explode("posts").alias("p")).select("row", "p.t", "p.pos")


def intersected(stored: DataFrame, anchors: DataFrame, key: str, on: list[Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """row, key, start: the places of the rarest term's list that all further lists agree with.

    ``on``: for each further rank what keeps those starts (row2, key, start, t2, offset2) that its postings (row, t, pos) agree with.
    """
    first = anchors.where("rank = 0").select(key, "t", "offset")
    found = lists(stored).join(small(first), "t").select("row", key, (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    found = C.written(found, "decontam-starts")
    posts = lists(stored.join(small(found.select("row").distinct()), "row", "left_semi"))
    for rank, test in enumerate(on, 1):
        more = anchors.where(F.col("rank") == rank).select(key, F.col("t").alias("t2"), F.col("offset").alias("offset2"))
        asked = found.join(small(more), key, "left")
        want = asked.where("t2 is not null").select(F.col("row").alias("row2"), key, "start", "t2", "offset2")
        held = test(want, posts)
        found = held.select(F.col("row2").alias("row"), key, "start").unionByName(asked.where("t2 is null").select("row", key, "start"))
    return found


def at_offset(want: DataFrame, posts: DataFrame) -> DataFrame:
    """Those whose further term stands at its own offset."""
    want = want.withColumn("pos2", F.col("start") + F.col("offset2"))
    return want.join(posts, (F.col("row2") == F.col("row")) & (F.col("t2") == F.col("t")) & (F.col("pos2") == F.col("pos")), "left_semi")


def within(span: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Those whose further term stands within ``span`` words; met through cells of that many words."""

    def test(want: DataFrame, posts: DataFrame) -> DataFrame:
        cell = F.floor(F.col("start") / span)
        want = want.withColumn("cell2", F.explode(F.array(cell - 1, cell, cell + 1)))
        posts = posts.withColumn("cell", F.floor(F.col("pos") / span))
        near = (F.col("row2") == F.col("row")) & (F.col("t2") == F.col("t")) & (F.col("cell2") == F.col("cell")) & (F.abs(F.col("pos") - F.col("start")) <= span)
        return want.join(posts, near, "left_semi").select("row2", *[c for c in want.columns if c not in ("row2", "cell2")]).distinct()

    return test


def phrases(docs: DataFrame, stored: DataFrame, anchors: DataFrame, wins: DataFrame) -> DataFrame:
    """Stored: h1, h2 (a text's name), wid, start, length of every exact occurrence of a window."""
    last = anchors.agg(F.max("rank")).first()[0] or 0
    survived = intersected(stored, anchors, "wid", [at_offset] * last)
    spots = survived.join(stored.select("row", "h1", "h2"), "row").select("h1", "h2", "wid", "start").distinct()
    sized = C.written(spots.join(small(wins.select("wid", F.size("words").alias("length"))), "wid"), "decontam-survivors")
    asked = sized.groupBy("h1", "h2").agg(F.collect_list(F.struct("wid", "start", "length")).alias("spots"))  # of one text
    text = F.coalesce(F.col("text"), F.lit(""))
    few = sized.limit(MOST_SENT + 1).count() <= MOST_SENT
    again = docs.select(F.xxhash64(F.lit(0), text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), "text").join(F.broadcast(asked) if few else asked, ["h1", "h2"])
    got = again.select("h1", "h2", C.words(F.col("text")).alias("w"), "spots").select("h1", "h2", F.explode(F.transform("spots", lambda s: F.struct(
        s["wid"].alias("wid"), s["start"].alias("start"), s["length"].alias("length"), F.slice("w", s["start"] + 1, s["length"]).alias("words")))).alias("s")).select("h1", "h2", "s.*")
    true = got.join(small(wins.select("wid", F.col("words").alias("want"))), "wid").where(F.col("words") == F.col("want"))
    return C.written(true.select("h1", "h2", "wid", "start", "length").distinct(), "decontam-phrases")


def proximity(stored: DataFrame, rare: DataFrame, span: int = SPAN) -> DataFrame:
    """row, item: rows where each of an item's rarest terms stands within ``span`` words of one place of the rarest."""
    last = rare.agg(F.max("rank")).first()[0] or 0
    return intersected(stored, rare.withColumn("offset", F.lit(0)), "item", [within(span)] * last).select("row", "item").distinct()


def report(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW, anchors: int = ANCHORS, near: bool = False) -> DataFrame:
    """Per row: kept columns, n_words, n_hit, n_items, items_sha256, contaminated (5 % of words hit); with near also n_near, items met by proximity."""
    wins, members = windows_of(items, size)
    vocabulary = C.written(item_words(items).select(F.explode("w").alias("term")).distinct(), "decontam-vocabulary")
    counts = C.written(term_counts(docs, vocabulary), "decontam-counts")
    chosen = C.written(rarest(wins.select("wid", F.posexplode("words").alias("offset", "term")), counts, "wid", anchors), "decontam-anchors")
    terms, rare = chosen.select("t"), None
    if near:
        rare = C.written(rarest(item_words(items).select("item", F.posexplode("w").alias("offset", "term")), counts, "item", NEAR_TERMS), "decontam-rare")
        terms = terms.union(rare.select("t"))
    stored = index(docs, terms, keep)
    hits = phrases(docs, stored, chosen, wins)
    spans = hits.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["start"] + s["length"]).alias("end")),
        lambda a: a["n"],
    )
    held = hits.select("h1", "h2", "wid").distinct().join(small(members), "wid").groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = spans.select("h1", "h2", covered.cast("long").alias("n_hit")).join(held, ["h1", "h2"])
    per = per.select("h1", "h2", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"))
    rows = stored.select("row", *keep, F.col("n_words").cast("long").alias("n_words"), "h1", "h2").join(small(C.written(per, "decontam-texts")), ["h1", "h2"], "left")
    extra = []
    if near:
        met = proximity(stored, rare).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
        rows = rows.join(met, "row", "left")
        extra = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *extra,
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), near=True)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, w[i : i + least(len(w), 13) - 1] AS win, least(len(w), 13) AS n
         FROM b, LATERAL unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
g AS (SELECT r, i, lens.n AS n, w[i : i + lens.n - 1] AS win
      FROM d, lens, LATERAL unnest(generate_series(1, len(w) - lens.n + 1)) AS t(i) WHERE len(w) >= lens.n),
hits AS (SELECT g.r, g.i, g.n, wins.item FROM g JOIN wins ON g.win = wins.win AND g.n = wins.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), LATERAL unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
it AS (SELECT DISTINCT item, unnest(w) AS term FROM b),
p AS MATERIALIZED (SELECT r, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS term FROM d),
n AS (SELECT term, count(*) AS n FROM p WHERE term IN (SELECT term FROM it) GROUP BY term),
rare AS (SELECT item, term, k FROM (SELECT item, it.term, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), it.term) AS k FROM it LEFT JOIN n ON n.term = it.term) WHERE k <= {NEAR_TERMS}),
p0 AS (SELECT r, item, pos FROM p JOIN rare ON p.term = rare.term AND k = 1),
p1 AS (SELECT p0.r, p0.item, p0.pos, count(DISTINCT rare.k) AS got FROM p0 JOIN rare ON rare.item = p0.item JOIN p ON p.r = p0.r AND p.term = rare.term AND abs(p.pos - p0.pos) <= {SPAN} GROUP BY p0.r, p0.item, p0.pos),
nr AS (SELECT r, count(DISTINCT p1.item) AS n_near FROM p1 JOIN (SELECT item, count(*) AS c FROM rare GROUP BY item) AS c ON c.item = p1.item AND got = c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN nr USING (r)
"""
