"""License scans by diagonal voting. DataFrame functions only.

Templates (the base phrases and longer notices) are word sequences. All rolling
word k-gram hashes of every text are tested against a bit table of the templates'
k-gram hashes inside the row; the survivors are joined with the templates' positions on hash and
words. A match votes for the diagonal "text position - template position" of its row and
template. A base phrase stands wherever one diagonal holds all of its k-grams. For the
longer notices the diagonals up to DRIFT after a first one (words added or left out) merge into one span.
Each span is verified by aligning it with its notice: of each template position the first text position
in the span counts if it lies behind those of all earlier template positions. A span counts if
what is aligned covers COVERAGE of the notice; of overlapping spans the best is reported.

Defined cases: null and empty texts have no words and no labels; texts of any length are whole;
repeated rows are scanned one by one; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import grams as G

#: Words in a k-gram of base phrases and notices; words that a span may add or leave out; share of a notice to align.
BASE_K, NOTICE_K, DRIFT, COVERAGE = 2, 3, 6, 0.75

# The contract's phrases, and notices with their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "spdx license identifier mit"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
]


def template_grams(spark: SparkSession, base: list, notices: list) -> DataFrame:
    """template, label, is_base, grams (how many it has), tpos, k, gram, h of every k-gram of every template."""
    rows = []
    for n, (label, text, is_base) in enumerate([(*b, True) for b in base] + [(*x, False) for x in notices]):
        w, k = text.split(), BASE_K if is_base else NOTICE_K
        k = min(k, len(w))
        rows += [(n, label, is_base, len(w) - k + 1, i, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "template int, label string, is_base boolean, grams int, tpos int, k int, gram string")
    return df.withColumn("h", F.xxhash64("gram"))


def matches(docs: DataFrame, tpl: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Stored: row, kept columns, n_words, hits (pos, gram) of the k-grams that some template may hold."""
    sizes = sorted({r.k for r in tpl.select("k").distinct().collect()})
    tables = {k: G.bit_table(G.hashes_of(tpl.where(F.col("k") == k), F.col("h"))) for k in sizes}

    def gram(i: Column, k: int) -> Column:
        return F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])

    def found(k: int) -> Column:
        n = F.size("w") - k + 1
        spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        hit = F.filter(spots, lambda i: G.may_hold(tables[k], F.xxhash64(gram(i, k))))
        return F.transform(hit, lambda i: F.struct(i.alias("pos"), gram(i, k).alias("gram")))

    split = docs.select(F.monotonically_increasing_id().alias("row"), *keep, C.words(F.col("text")).alias("w"))
    return C.written(split.select("row", *keep, F.size("w").cast("long").alias("n_words"), F.concat(*[found(k) for k in sizes]).alias("hits")), "license-hits")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), base: list = BASE, notices: list = NOTICES) -> DataFrame:
    """Kept columns, n_words, places (template, start) of base phrases, spans (template, first, last, coverage) of notices, labels."""
    spark = docs.sparkSession
    tpl = template_grams(spark, base, notices)
    stored = matches(docs, tpl, keep)
    hit = stored.select("row", F.explode("hits").alias("x")).select("row", "x.pos", "x.gram", F.xxhash64("x.gram").alias("h"))
    votes = (
        hit.join(F.broadcast(tpl), ["h", "gram"]).withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "template", "label", "is_base", "grams", "diagonal").agg(F.collect_set("tpos").alias("voted"))
    )
    key = ["row", "template", "label", "grams"]
    whole = votes.where(F.col("is_base") & (F.size("voted") == F.col("grams"))).groupBy("row").agg(F.collect_list(F.struct("label", F.col("diagonal").cast("long").alias("start"))).alias("places"))
    # a window holds one row's diagonals for one template
    line = Window.partitionBy(*key).orderBy("diagonal")
    near = votes.where(~F.col("is_base")).select(*key, "diagonal", F.collect_list(F.struct("diagonal", "voted")).over(line.rangeBetween(0, DRIFT)).alias("lines"))
    spots = F.array_sort(F.flatten(F.transform("lines", lambda x: F.transform(x["voted"], lambda t: F.struct(t.alias("tpos"), (x["diagonal"] + t).alias("pos"))))))
    start = F.struct(F.lit(-1).alias("tpos"), F.lit(-1).alias("last"), F.lit(0).alias("n"), F.lit(-1).alias("first"))

    def align(acc: Column, x: Column) -> Column:
        on = (x["tpos"] > acc["tpos"]) & (x["pos"] > acc["last"])
        return F.struct(
            x["tpos"].alias("tpos"), F.when(on, x["pos"]).otherwise(acc["last"]).alias("last"), (acc["n"] + on.cast("int")).alias("n"),
            F.when(on & (acc["first"] < 0), x["pos"]).otherwise(acc["first"]).alias("first"),
        )

    met = near.select(*key, "diagonal", F.aggregate(spots, start, align).alias("a")).withColumn("coverage", F.col("a.n") / F.col("grams"))
    before, after = F.max("coverage").over(line.rangeBetween(-DRIFT, -1)), F.max("coverage").over(line.rangeBetween(1, DRIFT))
    best = met.withColumn("before", before).withColumn("after", after).where((F.col("coverage") > F.coalesce("before", F.lit(0.0))) & (F.col("coverage") >= F.coalesce("after", F.lit(0.0))))
    span = F.struct("template", "label", F.col("a.first").alias("first"), (F.col("a.last") + NOTICE_K - 1).alias("last"), "coverage")
    spans = best.groupBy("row").agg(F.collect_list(span).alias("spans"))
    per = spans.join(whole, "row", "full")
    none = lambda c: F.coalesce(c, F.array().cast(per.schema[c].dataType)).alias(c)
    return stored.select("row", *keep, "n_words").join(per, "row", "left").select(*keep, "n_words", none("places"), none("spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(C.table(spark, sf_dir, "documents"))
    accepted = F.filter("spans", lambda s: s["coverage"] >= COVERAGE)
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.transform(accepted, lambda s: s["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _sql() -> str:
    """The same scan in DuckDB's SQL: k-grams joined to templates, diagonals merged and aligned."""
    tpl = ", ".join(f"({n}, '{label}', {str(b).lower()}, '{text}')" for n, (label, text, b) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in NOTICES]))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t0 AS (SELECT template, label, is_base, string_split(t, ' ') AS w, CASE WHEN is_base THEN {BASE_K} ELSE {NOTICE_K} END AS k FROM (VALUES {tpl}) AS v(template, label, is_base, t)),
t AS (SELECT template, label, is_base, k, len(w) - k + 1 AS grams, i - 1 AS tpos, array_to_string(w[i : i + k - 1], ' ') AS gram FROM t0, LATERAL unnest(generate_series(1, len(w) - k + 1)) AS u(i)),
ks AS (SELECT DISTINCT k FROM t),
g AS (SELECT r, i - 1 AS pos, ks.k AS k, array_to_string(w[i : i + ks.k - 1], ' ') AS gram FROM d, ks, LATERAL unnest(generate_series(1, len(w) - ks.k + 1)) AS u(i)),
v AS (SELECT DISTINCT r, template, label, is_base, grams, pos - tpos AS diag, tpos FROM g JOIN t USING (k, gram)),
l AS (SELECT r, template, label, is_base, grams, diag, count(*) AS votes FROM v GROUP BY ALL),
places AS (SELECT r, label, diag AS start FROM l WHERE is_base AND votes = grams),
spot AS (SELECT l.r, l.template, l.label, l.grams, l.diag, v.tpos, min(v.diag + v.tpos) AS pos
         FROM l JOIN v ON v.r = l.r AND v.template = l.template AND v.diag BETWEEN l.diag AND l.diag + {DRIFT} WHERE NOT l.is_base GROUP BY l.r, l.template, l.label, l.grams, l.diag, v.tpos),
run AS (SELECT *, max(pos) OVER (PARTITION BY r, template, diag ORDER BY tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spot),
spans AS (SELECT r, template, label, CAST(count(*) FILTER (WHERE far IS NULL OR pos > far) AS DOUBLE) / max(grams) AS coverage FROM run GROUP BY r, template, label, diag),
pa AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM spans WHERE coverage >= {COVERAGE}) GROUP BY r),
sc AS (SELECT r, max(coverage) AS best FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN pa USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""


SQL = _sql()
