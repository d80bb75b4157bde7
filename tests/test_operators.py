"""Hand-derived cases of each operator."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import casting as K
from millrace.functions import expressions as X
from millrace.functions import ordered as D
from millrace.functions import running as R
from millrace.functions import orderstats as O
from millrace.functions import scalars as S
from millrace.functions.running import block_of, cuts, running
from millrace.operators import aggregates, audit, clean, convert, duplicates, encode, envelope, features, missing, normalize, schema, windows
from millrace.plans.pipeline import Pipeline, merged

NUM = "i long, v double"


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")


def column(df, c="v"):
    return [r[c] for r in df.orderBy("i").collect()]


def test_is_missing(spark):
    df = frame(spark, [None, "", "  ", "NaN", "0"], "string")
    assert column(df.withColumn("v", K.is_missing(F.col("v")))) == [True, True, True, True, False]


def test_int_truncates(spark):
    df = frame(spark, ["1.9", "-1.9", "abc", "nan", "1_000", " 7 ", "1d", None], "string")
    out = convert.convert(df, {"v": "int"})
    assert column(out) == [1, -1, None, None, 1000, 7, None, None]
    assert column(out, "_valid") == [True, True, False, False, True, True, False, True]


def test_dates_day_first(spark):
    df = frame(spark, ["03/04/2024", "13/04/2024", "04/13/2024", "2024-1-2", "2024-01-02T03:04:05.5"], "string")
    out = convert.convert(df, {"v": "datetime"}).withColumn("v", F.date_format("v", "yyyy-MM-dd HH:mm:ss"))
    assert column(out) == ["2024-04-03 00:00:00", "2024-04-13 00:00:00", "2024-04-13 00:00:00", "2024-01-02 00:00:00", "2024-01-02 03:04:05"]


def test_inference(spark):
    df = spark.createDataFrame([("1", "1.5", "yes", "2024-01-02", "S001", None)], "a string, b string, c string, d string, e string, f string")
    assert K.inferred(df, df.columns) == {"a": "int", "b": "float", "c": "bool", "d": "datetime", "e": "string", "f": "string"}


def test_fail_on_error_raises(spark):
    with pytest.raises(Exception, match="not int"):
        convert.convert(frame(spark, ["x"], "string"), {"v": "int"}, fail_on_error=True).collect()


@pytest.mark.parametrize(("text", "want"), [("a / b", 0.0), ("-7 % 3", 2.0), ("zzz + 1", 1.0), ("7 // 2", 3.0), ("2 ** 3", 8.0), ("1 < 2 < 3", 1.0), ("5 if a > 1 else 6", 5.0), ("not b", 1.0), ("n + 1", 0.0), ("a and b", 0.0), ("__import__('os')", 0.0), ("a +", 0.0)])
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(2.0, 0.0, None)], "a double, b double, n double")
    assert df.select(X.arithmetic(text, df.schema)).first()[0] == want


def test_conditionals(spark):
    df = spark.createDataFrame([(2.0,)], "a double")
    got = df.select(X.conditional("a > 1 ? 10 : 20", df.schema), X.conditional("if a > 3 then 1 else 2", df.schema), X.conditional("nonsense", df.schema)).first()
    assert list(got) == [10.0, 2.0, 0.0]


def test_percentiles_by_floor_index(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0])
    got = O.group_percentiles(df, [], "v").first()
    assert (got.p25, got.p50, got.p75, got.p99) == (2.0, 3.0, 4.0, 4.0)
    arr = df.agg(F.collect_list("v").alias("a")).select(O.pick(F.col("a"), 0.5)).first()
    assert list(arr) == [3.0] and O.group_statistics(df, [], "v", ["median"]).first().median == 2.5


def test_group_places_cross_partitions(spark):
    """Groups larger than a partition of the sort, a null group, nulls, repeated values, and a group without values."""
    rng = random.Random(1)
    rows = [(g, rng.choice([None, float(rng.randrange(40)), rng.random()])) for g in (["a"] * 300 + ["b"] * 5 + [None] * 50)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r for r in O.group_statistics(df, ["g"], "v", ["median", *O.PERCENTILES]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        s = sorted(v for h, v in rows if h == g and v is not None)
        assert r.median == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert all(r[k] == s[min(int(len(s) * p), len(s) - 1)] for k, p in O.PERCENTILES.items())
    assert O.group_statistics(df.where("false"), ["g"], "v", ["median"]).count() == 0


def test_selected_places_of_stretches():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        symbols = rng.permutation(n)
        left = rng.integers(0, n, 200)
        right = left + 1 + (rng.integers(0, n, 200) % (n - left))
        place = rng.integers(0, n, 200) % (right - left)
        got = O.selected(symbols, left, right, place)
        assert got.tolist() == [sorted(symbols[a:b])[k] for a, b, k in zip(left, right, place, strict=True)]


@pytest.fixture
def no_merging(spark):
    """Small shuffles stay in many partitions, so that groups span blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("back", "parts", "times"), [(None, None, 20), (5, None, 20), (None, 9, 20), (5, 9, 20), (3, 12, 200), (60, 12, 200), (1000, 7, 200), (0, 9, 4), (2, 9, 3)])
def test_running_statistics(spark, no_merging, back, parts, times):
    """Frames inside one block, over some and over all; ties that span blocks; values that drift."""
    rng = random.Random(3)
    value = lambda i: rng.choice([None, 1.0, 2.0, 2.0, 7.5, float("nan"), float(i), -float(i), float(rng.randrange(100))])
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(times), i, value(i)) for i in range(300)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "g string, t long, i long, x double, _x string").repartition(3)
    got = {r.i: r for r in O.running_statistics(df, [F.col("g")], [F.col("t"), F.col("i")], F.col("x"), {"m": "median", "p": "p90", "q": "p25", "u": "unique"}, back, parts).collect()}
    assert len(got) == len(rows)
    key = lambda v: (v != v, v)
    for g, t, i, _ in rows:
        frame = [(u, j, x) for h, u, j, x in rows if h == g and ((t - back <= u <= t) if back is not None else (u, j) <= (t, i))]
        s = sorted((x for *_, x in frame if x is not None), key=key)
        r = got[i]
        assert r.u == len({str(x) for x in s})
        if s:
            want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, s[min(int(len(s) * 0.9), len(s) - 1)], s[int(len(s) * 0.25)]
            assert all(a == b or (a != a and b != b) for a, b in zip((r.m, r.p, r.q), want, strict=True))
        else:
            assert r.m is None and r.p is None


def test_running_statistics_without_groups(spark, no_merging):
    rng = random.Random(5)
    x = [rng.gauss(i / 50, 3.0) for i in range(900)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    got = [r.m for r in O.running_statistics(df, [], [F.col("i")], F.col("x"), {"m": "median"}, None, 15).orderBy("i").collect()]
    assert got == [float(np.median(x[: i + 1])) for i in range(900)]
    assert O.running_statistics(df.where("false"), [], [F.col("i")], F.col("x"), {"m": "median", "u": "unique"}).count() == 0


def sent(spark, monkeypatch, kinds, rows, bits, ranges):
    """Rows of each block, and how many earlier values each block gets, of rows that all lie in one partition."""
    monkeypatch.setattr("millrace.functions.ordered.BLOCK_BITS", bits)
    monkeypatch.setattr("millrace.functions.orderstats.RANGE_BITS", ranges)
    df = spark.range(rows).selectExpr("id", "double(pmod(hash(id), 1000)) AS x", "1L AS g0", "2L AS g1", "CAST(NULL AS long) AS t")
    df = D.placed(df, ["id"], "pos", "test", 1).withColumn("block", D.block_of("pos"))
    prior = O._prior(df, kinds, None)
    got = {r.target: r.n for r in prior.where("kind = 1").groupBy("target").agg(F.count("x").alias("n")).collect()} if prior else {}
    return [r["count"] for r in df.groupBy("block").count().collect()], got


def test_blocks_of_one_partition_get_about_their_own_rows(spark, monkeypatch):
    """However few partitions the rows are in, neither a block nor what it gets grows with the table."""
    for rows in (2000, 8000):
        blocks, got = sent(spark, monkeypatch, ["median"], rows, 8, 6)
        assert len(blocks) == -(-rows // 256) and max(blocks) == 256
        assert len(got) == len(blocks) - 1 and max(got.values()) <= 256 + 2 * 64 + 4


def test_running_percentiles_get_a_few_ranges_for_each_place(spark, monkeypatch):
    _, got = sent(spark, monkeypatch, ["p25", "p75", "p90", "p99"], 8000, 8, 6)
    assert max(got.values()) <= 4 * (256 + 2 * 64 + 4)
    x = [float(v) for v in np.random.default_rng(1).integers(0, 50, 1500)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    made = {"m": "median", "a": "p25", "b": "p90", "q": "q3"}
    for r in O.running_statistics(df, [], [F.col("i")], F.col("x"), made, None, 2).collect():
        s = sorted(x[: r.i + 1])
        n = len(s)
        assert (r.m, r.a, r.b, r.q) == ((s[(n - 1) // 2] + s[n // 2]) / 2, s[min(int(n * 0.25), n - 1)], s[min(int(n * 0.9), n - 1)], s[3 * n // 4])


@pytest.mark.parametrize("what", ["median", "robust"])
def test_online_statistics_cross_blocks_of_one_partition(spark, monkeypatch, what):
    """Rows of a single partition are cut into blocks, and what is seen at marks is carried over them."""
    monkeypatch.setattr("millrace.functions.ordered.BLOCK_BITS", 5)
    monkeypatch.setattr("millrace.functions.orderstats.RANGE_BITS", 3)
    held = []
    solve = O._prior
    monkeypatch.setattr(O, "_prior", lambda *a: held.append(solve(*a)) or held[-1])
    x = [float(v) for v in np.random.default_rng(2).integers(0, 99, 200)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, v double")
    if what == "median":
        out = column(missing.online(df, "v", "fill_median", "i", "m", 20, 1), "m")
        want = [None if i < 19 else float(np.median(x[: (i + 1) // 20 * 20])) for i in range(200)]
    else:
        out = column(normalize.online(df, "v", "i", "robust", 20, "m", parts=1), "m")
        seen = [sorted(x[: (i + 1) // 20 * 20]) for i in range(200)]
        want = [v if not s else (v - float(np.median(s))) / max(s[3 * len(s) // 4] - s[len(s) // 4], 1e-8) for v, s in zip(x, seen, strict=True)]
    assert out == pytest.approx(want) and held[0] is not None


def test_nested_conditionals(spark):
    df = spark.createDataFrame([(2.0, 5.0)], "a double, b double")
    texts = {"a > 1 ? (b > 9 ? 1 : 2) : 3": 2.0, "a > 5 ? 1 : b > 4 ? 2 : 3": 2.0, "if a > 1 then if b > 9 then 1 else 4 else 3": 4.0, "(a + 1) * 2 > 5 ? (a) + (b) : 0": 7.0, "a ? 1": 0.0}
    got = df.select(*[X.conditional(t, df.schema) for t in texts]).first()
    assert list(got) == list(texts.values())


def test_runtime_changes(spark):
    df = frame(spark, [1.0, 5.0])
    cleaner = clean.Cleaner(action="log_warn")
    cleaner.add(clean.Rule("v", max_value=2.0))
    assert cleaner.apply(df).where("_valid").count() == 2 and cleaner.apply(df).where("size(_warnings) > 0").count() == 1
    cleaner.add(clean.Rule("v", "reject", max_value=2.0))
    assert cleaner.apply(df).where("_valid").count() == 1 and cleaner.remove("v") and not cleaner.remove("v") and cleaner.apply(df).where("_valid").count() == 2
    builder = features.Builder()
    builder.add(features.Feature("twice", "arithmetic", "v * 2"))
    assert [r.twice for r in builder.apply(df).orderBy("i").collect()] == [2.0, 10.0] and builder.remove("twice") and "twice" not in builder.apply(df).columns
    validator = schema.Validator(schema.fields_of(field_types={"v": "float"}))
    assert [c for c in validator.apply(df).columns if c[0] != "_"] == ["v"]
    validator.swap(field_types={"i": "int"})
    assert [c for c in validator.apply(df).columns if c[0] != "_"] == ["i"]


def test_each_value_is_inferred(spark):
    texts = ["1", "1.5", "yes", "2024-01-02", "03/04/2024", "S001", "", None, "-7_000", "12-34"]
    got = {r.v: r.x for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", K.inferred_value(F.col("v")).alias("x")).collect()}
    assert [got[t].type for t in texts] == ["int", "float", "bool", "datetime", "datetime", "string", None, None, "int", "string"]
    assert got["-7_000"].int == -7000 and got["1.5"].float == 1.5 and got["yes"].bool is True and got["S001"].string == "S001" and got["2024-01-02"].datetime.day == 2


def test_missing_statistics(spark):
    df = frame(spark, [1.0, None, None, 4.0])
    done = missing.impute(df, ["v"], "fill_mean")
    assert missing.stats(df, ["v"], done).first().asDict() == {"field": "v", "total_rows": 4, "missing": 2, "filled": 2, "rejected": 0}
    done = missing.impute(df, ["v"], "reject")
    assert missing.stats(df, ["v"], done).first().asDict() == {"field": "v", "total_rows": 4, "missing": 2, "filled": 0, "rejected": 2}


def test_pipeline_precedence_and_statistics(spark):
    base = {"transformation": {"data_cleaning": {"enabled": True, "rules": {"v": {"max_value": 2.0}}, "global_action": "reject"}}}
    df = frame(spark, [1.0, 5.0, 9.0])
    p = Pipeline.of(base, "i", defaults={"strict_mode": True, "transformation": {"data_cleaning": {"enabled": False}}})
    assert p.strict and {r.stage: (r["rows"], r.failed) for r in p.stats(df).collect()} == {"clean": (3, 2), "total": (3, 2)}
    off = Pipeline.of(base, "i", overrides={"transformation": {"data_cleaning": {"enabled": False}}})
    assert off.accepted(df).count() == 3


def test_deviations(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("g", F.lit("x")).withColumn("t", F.timestamp_seconds("i"))
    pop = aggregates.running(df, aggregates.Aggregation("a", "v", ["g"], ["std"]), "i").orderBy("i").collect()
    assert pop[0].a_std == 0.0 and math.isclose(pop[3].a_std, 1.118033988749895)
    w = windows.running(df, windows.TimeWindow("w", "v", "t", "global", functions=["std"], group_by=["g"]), "i").orderBy("i").collect()
    assert w[0].w_std == 0.0 and math.isclose(w[3].w_std, 1.2909944487358056)


def test_blocks_follow_the_rows(spark, monkeypatch):
    """An outlier and a crowded range: blocks stay of about one size, and running values cross them."""
    monkeypatch.setattr("millrace.functions.running.BLOCK_ROWS", 40)
    order = [*range(600), 10**12, *[2000 + k for k in range(0, 4000, 10)]]
    df = spark.createDataFrame([(i, 1.0) for i in order], "i long, v double")
    bounds = cuts(df, "i", 64)
    sizes = [r["count"] for r in df.groupBy(block_of(F.col("i"), bounds).alias("b")).count().collect()]
    assert 10 < len(sizes) <= 64 and max(sizes) <= 5 * 1001 / len(sizes)
    got = column(running(df, "i", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, blocks=64), "n")
    assert got == list(range(1, len(order) + 1)) and cuts(df.where("false"), "i") == []


def test_global_running_crosses_blocks(spark):
    df = frame(spark, [float(i % 7) if i % 5 else None for i in range(300)])
    out = running(df, "i", {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "l": ("last", F.col("v"))}, blocks=16).orderBy("i").collect()
    s = n = 0
    last = None
    for i, r in enumerate(out):
        if i % 5:
            s, n, last = s + i % 7, n + 1, float(i % 7)
        assert (r.s, r.n, r.l) == (s, n, last)


@pytest.mark.parametrize(("strategy", "want"), [("robust", [-0.75, -0.25, 0.25, 0.75]), ("min_max", [0.0, 1 / 3, 2 / 3, 1.0]), ("max_abs", [0.25, 0.5, 0.75, 1.0]), ("none", [1.0, 2.0, 3.0, 4.0])])
def test_scaling(spark, strategy, want):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0])
    assert column(normalize.Normalizer(["v"], strategy).fit(df).transform(df)) == pytest.approx(want)


def test_scaling_corner_cases(spark):
    same = frame(spark, [5.0, 5.0])
    assert column(normalize.Normalizer(["v"]).fit(same).transform(same)) == [0.0, 0.0]
    low = frame(spark, [-3.0, 0.0, 4.0])
    assert column(normalize.Normalizer(["v"], "log").fit(low).transform(low)) == pytest.approx([0.0, math.log(4), math.log(8)])
    unit = spark.createDataFrame([(0, 3.0, 4.0), (1, 0.0, 0.0)], "i long, v double, w double")
    out = normalize.Normalizer(["v", "w"], "unit_vector").fit(unit).transform(unit)
    assert column(out) == pytest.approx([0.6, 0.0]) and column(out, "_valid") == [True, False]


def test_label_and_bits(spark):
    df = frame(spark, ["b", "a", "a", "c"], "string")
    assert column(encode.Encoder(["v"]).fit(df, "i").transform(df)) == [1, 0, 0, 2]
    four = frame(spark, ["a", "b", "c", "d"], "string")
    out = encode.Encoder(["v"], "binary").fit(four, "i").transform(four).orderBy("i").collect()
    assert (out[2].v_bin_0, out[2].v_bin_1, out[2].v_bin_2) == (0, 1, 0)


def test_unknown_categories(spark):
    df, new = frame(spark, ["a", "b"], "string"), frame(spark, ["a", "z", None], "string")
    m = encode.Encoder(["v"]).fit(df, "i")
    assert column(m.transform(new), "_valid") == [True, False, False]
    with pytest.raises(Exception, match="unknown category"):
        encode.EncoderModel(encode.Encoder(["v"], handle_unknown="error"), m.categories, m.counts, m.totals, {}).transform(new).collect()


def test_mode_takes_the_first_of_ties(spark):
    df = frame(spark, [2.0, 1.0, 2.0, 1.0, 3.0, None])
    assert column(missing.impute(df, ["v"], "fill_mode", order="i"))[-1] == 2.0


def test_fills(spark):
    df = frame(spark, [None, 5.0, None, None, 7.0, None])
    assert column(missing.impute(df, ["v"], "fill_forward", order="i")) == [None, 5.0, 5.0, 5.0, 7.0, 7.0]
    assert column(missing.impute(df, ["v"], "fill_backward", order="i")) == [5.0, 5.0, 7.0, 7.0, 7.0, None]
    assert column(missing.impute(df, ["v"], "fill_median")) == [6.0, 5.0, 6.0, 6.0, 7.0, 6.0]


def test_duplicates(spark):
    df = frame(spark, ["a", "b", "a", "a", None, None], "string")
    keep = lambda s: [r.i for r in duplicates.dedup(df, "i", ["v"], s).where("_valid").orderBy("i").collect()]
    assert keep("reject") == [0, 1, 4] and keep("keep_last") == [1, 3, 5]
    marked = duplicates.dedup(df, "i", ["v"], "mark").orderBy("i").collect()
    assert [r._is_duplicate for r in marked] == [False, False, True, True, False, True] and marked[3]._first_seen_index == 0


def test_duplicates_of_copies_ties_and_null_orders(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "b", 2.0), (1, "b", 3.0), (None, "b", 4.0), (3, None, 5.0), (3, None, 5.0), (0, "c", 6.0)] + [(5, "hot", float(k % 2)) for k in range(2500)]
    df = spark.createDataFrame(rows, "t int, k string, x double")
    for strategy in ("reject", "keep_first", "keep_last"):
        out = duplicates.dedup(df, "t", ["k"], strategy)
        assert out.count() == len(rows)
        kept = {r.k: r for r in out.where("_valid").collect()}
        assert out.where("_valid").count() == len(kept) == 5
        assert kept["b"].x == (2.0 if strategy == "keep_last" else 4.0) and kept["a"].x == 1.0  # a null order comes first
    marked = duplicates.dedup(df, "t", ["k"], "mark")
    assert marked.where("_is_duplicate").count() == len(rows) - 5 and marked.where("k = 'a' AND _is_duplicate").first()._first_seen_index == 1
    assert marked.columns == [*audit.audited(df).columns, "_is_duplicate", "_duplicate_key", "_first_seen_index"]
    whole = duplicates.dedup(df.withColumn("_row", F.lit(1)), "t")
    assert whole.where("_valid").count() == df.select("k", "x").distinct().count() and "_row" in whole.columns
    bad = duplicates.dedup(df, "t", ["k"]).where("k = 'a' AND NOT _valid").first()._errors[0]
    assert (bad.field, bad.error, bad.value) == ("_duplicate", "duplicate_row", "k=a")
    assert duplicates.dedup(df.where("false"), "t", ["k"]).count() == 0


def test_rules(spark):
    df = frame(spark, [0.0, 10.0, -1.0, 11.0, None])
    assert column(clean.clean(df, [clean.Rule("v", "reject", 0, 10)]), "_valid") == [True, True, False, False, True]
    assert column(clean.clean(df, [clean.Rule("v", "cap", 0.0, 10.0)])) == [0.0, 10.0, 0.0, 10.0, None]
    text = frame(spark, ["A", "C", None, "abc", "xab"], "string")
    assert column(clean.clean(text, [clean.Rule("v", allowed_values=["A", "B"])]), "_valid") == [True, False, False, False, False]
    assert column(clean.clean(text, [clean.Rule("v", pattern="ab")]), "_valid") == [False, False, True, True, False]
    assert column(clean.clean(text, [clean.Rule("v", "remove_field", forbidden_values=["A"], pattern="C")])) == [None, "C", None, None, None]


def test_schema(spark):
    df = spark.createDataFrame([(0, "25.0", "yes"), (1, "25.3", "no"), (2, None, "x")], "i long, n string, b string")
    out = schema.validate(df, schema.fields_of([{"name": "i", "type": "int"}, {"name": "n", "type": "int"}, {"name": "b", "type": "bool", "required": False}]))
    assert column(out, "n") == [25, None, None] and column(out, "b") == [True, False, None] and column(out, "_valid") == [True, False, False]
    with pytest.raises(Exception, match="schema"):
        schema.validate(df, schema.fields_of([{"name": "n", "type": "int"}]), strict=True).collect()


def test_trailing_tumbling_session(spark):
    at = lambda *secs: spark.createDataFrame([(i, float(i), s) for i, s in enumerate(secs)], "i long, v double, s long").withColumn("t", F.timestamp_seconds("s"))
    counts = lambda df, **o: column(windows.running(df, windows.TimeWindow("w", "v", "t", functions=["count"], **o), "i"), "w_count")
    assert counts(at(0, 60, 61), size=60) == [1, 2, 2]
    assert counts(at(0, 59, 60), type="tumbling", size=60) == [1, 2, 1]
    assert counts(at(0, 30, 61), type="session", size=30) == [1, 2, 1]
    rate = windows.running(at(0, 60, 120), windows.TimeWindow("w", "v", "t", "global", functions=["rate"]), "i")
    assert column(rate, "w_rate") == pytest.approx([0.0, 2.0, 1.5])


@pytest.mark.parametrize(("kind", "groups"), [("sliding", ["g"]), ("sliding", []), ("global", []), ("global", ["g"])])
def test_rates_of_a_few_microseconds_are_exact(spark, kind, groups):
    """Seconds since 1970 as doubles have no exact microseconds."""
    df = spark.createDataFrame([(0, 1704067211172425), (1, 1704067211172426), (2, 1704067211185427)], "i long, us long").withColumns({"t": F.timestamp_micros("us"), "v": F.lit(1.0), "g": F.lit(1)})
    out = windows.running(df, windows.TimeWindow("w", "v", "t", kind, 60, functions=["rate"], group_by=groups), "i")
    assert column(out, "w_rate") == [0.0, 2 / (1 / 6e7), 3 / (13002 / 6e7)]


def test_durations():
    assert [windows.duration(x) for x in (90, "90", "5 minutes", "1h", "1 day 2 hours", None)] == [90, 90.0, 300.0, 3600.0, 93600.0, None]


def test_envelope_and_routing(spark):
    df = spark.createDataFrame([("T001", "2025-01-01", "25.0", "active")], "sensor_id string, timestamp string, temperature string, status string")
    m = envelope.envelope(df, "csv", extra={"source_type": "csv"}).first()
    assert m.event_type == "data_point" and m.data.temperature == "25.0" and m.metadata["sensor_id"] == "T001" and m.metadata["source_type"] == "csv"
    assert df.select(envelope.topic(F.lit("Stream-Exchange"), F.lit("a.B"))).first()[0] == "stream_exchange__a.b"


def test_scalars(spark):
    df = spark.createDataFrame([("abcdefghij",)], "s string")
    assert df.select(S.truncated(F.col("s"), 5)).first()[0] == "ab..." and df.select(S.group_key([])).first()[0] == "_global_"


def test_strict_and_accumulating(spark):
    df = frame(spark, ["x", "1"], "string")
    loose = clean.clean(convert.convert(df, {"v": "int"}), [clean.Rule("v", allowed_values=[2])])
    strict = clean.clean(convert.convert(df, {"v": "int"}), [clean.Rule("v", allowed_values=[2])], strict=True)
    assert [len(e) for e in column(loose, "_errors")] == [2, 1] and [len(e) for e in column(strict, "_errors")] == [1, 1]


def test_pipeline_rejects_and_enriches(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 99.0), (2, "b", 3.0), (2, "b", 3.0)], "id long, k string, v double")
    cfg = {"validation": {"duplicate": {"enabled": True, "key_fields": ["k"], "strategy": "mark"}}, "transformation": {"data_cleaning": {"enabled": True, "rules": {"v": {"max_value": 50.0}}}}, "features": {"feature_builder": {"enabled": True, "features": [{"name": "w", "feature_type": "arithmetic", "expression": "v * 2"}]}, "aggregation": {"enabled": False}}}
    df = df.limit(3)
    out = Pipeline.of(cfg, "id").fit(df).apply(df)
    assert audit.stats(out).first().rejected_rows == 1 and {r.w for r in out.where("_valid").collect()} == {2.0, 6.0}
    assert merged({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}}


def test_empty_frames(spark):
    df = frame(spark, [])
    assert missing.impute(df, ["v"], "fill_mean").count() == 0
    assert normalize.Normalizer(["v"]).fit(df).transform(df).count() == 0
    assert running(df, "i", {"s": ("sum", F.col("v"))}).count() == 0
    assert aggregates.grouped(df, aggregates.Aggregation("a", "v", ["i"], ["sum", "p50"]), "i").count() == 0
    assert isinstance(df.schema["v"].dataType, T.DoubleType)


def test_blocks_carry_running_values(spark, no_merging):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, float(rng.randrange(50))])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(4)
    kinds = {"n": "count", "s": "sum", "lo": "min", "hi": "max", "f": "first", "l": "last"}
    for inclusive in (True, False):
        got = {r.i: r for r in R.Blocks.of(df, [F.col("g")], [F.col("i")], 11).running({k: (v, F.col("x")) for k, v in kinds.items()}, inclusive).rows(*kinds).collect()}
        for g, i, _ in rows:
            seen = [v for h, j, v in rows if h == g and (j <= i if inclusive else j < i) and v is not None]
            r = got[i]
            assert (r.n, r.s) == (len(seen), sum(seen)) and (r.lo, r.hi, r.f, r.l) == ((min(seen), max(seen), seen[0], seen[-1]) if seen else (None,) * 4)


@pytest.mark.parametrize(("back", "times"), [(0, 5), (3, 5), (20, 300), (400, 300), (1000, 300)])
def test_trailing_frames_span_blocks(spark, no_merging, back, times):
    rng = random.Random(back)
    rows = [(rng.choice(["a", "a", "b"]), rng.randrange(times), i, rng.choice([None, float(rng.randrange(50))])) for i in range(250)]
    df = spark.createDataFrame(rows, "g string, t long, i long, x double")
    for groups in ([], ["g"]):
        out = R.trailing(df, [F.col(c) for c in groups], F.col("t"), back, lambda w: {"n": F.count("x").over(w), "s": F.sum("x").over(w), "hi": F.max("x").over(w)}, 9)
        got = {r.i: r for r in out.collect()}
        assert len(got) == len(rows)
        for g, t, i, _ in rows:
            seen = [v for h, u, _, v in rows if (not groups or h == g) and t - back <= u <= t and v is not None]
            assert (got[i].n, got[i].s, got[i].hi) == (len(seen), sum(seen) if seen else None, max(seen, default=None))


@pytest.mark.parametrize(("bits", "back", "times"), [(17, 20, 300), (3, 0, 5), (3, 3, 5), (3, 20, 300), (4, 400, 300), (3, 30, 3000)])
def test_totals_of_trailing_frames(spark, no_merging, monkeypatch, bits, back, times):
    """Frames inside a block, over some and over all; ties that span blocks; NaN is the largest number."""
    monkeypatch.setattr("millrace.functions.ordered.BLOCK_BITS", bits)
    rng = random.Random(back)
    rows = [(rng.choice(["a", "a", "b"]), rng.choice([None, *range(times)]), i, rng.choice([None, float("nan"), *map(float, range(20))])) for i in range(250)]
    df = spark.createDataFrame(rows, "g string, t long, i long, x double")
    x = F.when(F.col("t").isNotNull(), F.col("x"))
    for groups in ([], ["g"]):
        got = {r.i: r for r in R.trailing_totals(df, [F.col(c) for c in groups], F.col("t"), back, {"n": ("count", x), "s": ("sum", x), "hi": ("max", x), "lo": ("min", x)}, 5).collect()}
        assert len(got) == len(rows)
        for g, t, i, _ in rows:
            if t is None:
                continue
            seen = [v for h, u, _, v in rows if u is not None and (not groups or h == g) and t - back <= u <= t and v is not None]
            good = [v for v in seen if v == v]
            most = None if not seen else math.nan if len(good) < len(seen) else max(seen)
            want = (len(seen), most if most is None or most != most else sum(seen), most, min(good, default=math.nan) if seen else None)
            assert all(a == b or (a is not None and b is not None and a != a and b != b) for a, b in zip((got[i].n, got[i].s, got[i].hi, got[i].lo), want, strict=True))


def test_trailing_windows_do_not_go_through_each_frame(spark, monkeypatch):
    """Every row's frame holds all rows before it: no window function may walk through them."""
    monkeypatch.setattr(R, "trailing", None)
    df = spark.range(3000).selectExpr("id AS i", "timestamp_seconds(id) AS t", "double(id % 7) AS v")
    out = windows.running(df, windows.TimeWindow("w", "v", "t", "sliding", 3600, functions=["count", "sum", "mean", "min", "max", "rate"]), "i").orderBy("i").collect()
    v = [float(i % 7) for i in range(3000)]
    assert [(r.w_count, r.w_sum, r.w_min, r.w_max) for r in out] == [(i + 1, sum(v[: i + 1]), 0.0, max(v[: i + 1])) for i in range(3000)]
    assert out[60].w_rate == 61.0 and out[60].w_mean == sum(v[:61]) / 61


def test_running_rates_do_not_go_through_each_frame(spark, monkeypatch):
    monkeypatch.setattr(R, "trailing", None)
    df = spark.range(2000).selectExpr("id AS i", "timestamp_seconds(id) AS t", "double(id % 7) AS v")
    out = aggregates.running(df, aggregates.Aggregation("a", "v", [], ["rate"], "t", 600, strict_window=True), "i")
    assert column(out, "a_rate") == [0.0, *[(min(i, 600) + 1) / (min(i, 600) / 60) for i in range(1, 2000)]]


def test_last_rows_and_sessions_span_blocks(spark, no_merging):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b"]), i, float(rng.randrange(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    for groups in ([], ["g"]):
        got = {r.i: r.s for r in R.last_rows(df, [F.col(c) for c in groups], [F.col("i")], 7, lambda w: {"s": F.sum("x").over(w)}, 20, 9).collect()}
        for k, (g, i, _) in enumerate(rows):
            assert got[i] == sum([x for h, _, x in rows[: k + 1] if not groups or h == g][-7:])
    at, times = 0, []
    for i in range(200):
        at += rng.choice([1, 1, 5, 11])
        times.append(at)
    rows = [(rng.choice(["a", "a", "b"]), i, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "g string, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.i: r._session for r in windows.session_ids(df, "ts", ["g"], 10, "i", 9).collect()}
    last, number = {}, {}
    for g, i, t in rows:
        number[g] = number.get(g, 0) + (g in last and t - last[g] > 10)
        last[g] = t
        assert got[i] == number[g]


@pytest.mark.parametrize("parts", [None, 7])
def test_online_statistics_span_blocks(spark, no_merging, parts):
    rng = random.Random(6)
    x = [rng.choice([None, float(rng.randrange(8)), float(rng.randrange(3))]) for _ in range(137)]
    df = spark.createDataFrame(list(enumerate(x)), "i long, x double").repartition(3)
    got = {how: [r.s for r in missing.online(df, "x", how, "i", "s", 10, parts).orderBy("i").collect()] for how in ("fill_mean", "fill_median", "fill_mode")}
    for i in range(len(x)):
        seen = [v for v in x[: (i + 1) // 10 * 10] if v is not None]
        want = {"fill_mean": sum(seen) / len(seen), "fill_median": float(np.median(seen)), "fill_mode": max(seen, key=lambda v: (seen.count(v), -seen.index(v)))} if seen else dict.fromkeys(got)
        assert all(got[h][i] == (want[h] if want[h] is None else pytest.approx(want[h])) for h in got)
    with pytest.raises(ValueError, match="order"):
        missing.impute(df, ["x"], "fill_median", mode="online")
    for strategy in ("min_max", "max_abs", "log", "robust", "z_score"):
        out = [r.x for r in normalize.online(df, "x", "i", strategy, 10, parts=parts).orderBy("i").collect()]
        assert out[:9] == x[:9] and [v is None for v in out] == [v is None for v in x]
        seen = sorted(v for v in x[:130] if v is not None)
        k, v = next((k, v) for k, v in reversed(list(enumerate(x))) if v is not None)
        n = len(seen)
        want = {
            "min_max": (v - seen[0]) / (seen[-1] - seen[0]), "max_abs": v / seen[-1], "log": math.log(v + 1) if seen[0] <= 0 else math.log(v),
            "robust": (v - float(np.median(seen))) / (seen[3 * n // 4] - seen[n // 4]), "z_score": (v - float(np.mean(seen))) / float(np.std(seen)),
        }
        assert out[k] == pytest.approx(want[strategy])
