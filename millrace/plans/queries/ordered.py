"""Order without one task for all: running and trailing values without a group, and statistics as seen so far."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import learning, missing, normalize, observed
from millrace.operators import windows as W
from millrace.plans.pipeline import Pipeline
from millrace.plans.queries.base import GAPPY, big, events, gappy, query, r6

# The places that percentiles take.
_P = {"p25": 0.25, "p75": 0.75, "p90": 0.9, "p99": 0.99}
_SO_FAR = "(ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_DAY = "(ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"
_places = ", ".join(f"round(l[CAST(least(floor(len(l) * CAST({p} AS DOUBLE)), len(l) - 1) AS INT) + 1], 6) AS a_{k}" for k, p in _P.items())
_SIX = "(ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)"


@query("running_median_of_all", f"SELECT event_id, round(median(value) OVER {_SO_FAR}, 6) AS a_median FROM events")
def running_median_of_all(t):
    out = A.running(t("events"), A.Aggregation("a", "value", [], ["median"]), "event_id")
    return out.select("event_id", r6("a_median").alias("a_median"))


@query("running_median_by_type", "SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS a_median FROM events")
def running_median_by_type(t):
    """Few groups, each with a large share of all rows."""
    out = A.running(t("events"), A.Aggregation("a", "value", ["event_type"], ["median"]), "event_id")
    return out.select("event_id", r6("a_median").alias("a_median"))


@query("running_percentiles_of_all", f"SELECT event_id, {_places} FROM (SELECT event_id, list_sort(list(value) OVER w) AS l FROM events WINDOW w AS {_SO_FAR})")
def running_percentiles_of_all(t):
    out = A.running(t("events"), A.Aggregation("a", "value", [], list(_P)), "event_id")
    return out.select("event_id", *[r6(f"a_{k}").alias(f"a_{k}") for k in _P])


@query("running_unique_of_all", f"WITH f AS (SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS new FROM events) SELECT event_id, sum(new) OVER {_SO_FAR} AS a_unique FROM f")
def running_unique_of_all(t):
    out = A.running(t("events"), A.Aggregation("a", "user_id", [], ["unique"]), "event_id")
    return out.select("event_id", big("a_unique").alias("a_unique"))


@query("running_rate_of_all", f"WITH w AS (SELECT event_id, count(*) OVER w AS n, epoch_us(ts) / 1e6 AS t, first_value(epoch_us(ts)) OVER w / 1e6 AS f FROM events WINDOW w AS {_SO_FAR}), k AS (SELECT event_id, count(*) OVER k AS kept, min(epoch_us(ts)) OVER k / 1e6 AS low FROM events WINDOW k AS {_SIX}) SELECT event_id, round(CASE WHEN n < 2 THEN 0 WHEN t - f <= 0 THEN n ELSE n / ((t - f) / 60) END, 6) AS a_rate, round(CASE WHEN kept < 2 THEN 0 WHEN t - low <= 0 THEN kept ELSE kept / ((t - low) / 60) END, 6) AS b_rate FROM w JOIN k USING (event_id)")
def running_rate_of_all(t):
    out = A.running(events(t), A.Aggregation("a", "value", [], ["rate"], "ts"), "event_id")
    out = A.running(out, A.Aggregation("b", "value", [], ["rate"], "ts", 6 * 3600, strict_window=True), "event_id")
    return out.select("event_id", r6("a_rate").alias("a_rate"), r6("b_rate").alias("b_rate"))


@query("running_hot_group", "SELECT event_id, count(value) OVER w AS a_count, round(sum(value) OVER w, 4) AS a_sum, min(value) OVER w AS a_min, max(value) OVER w AS a_max, first_value(value) OVER w AS a_first, last_value(value) OVER w AS a_last FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_hot_group(t):
    out = A.running(t("events"), A.Aggregation("a", "value", ["event_type"], ["count", "sum", "min", "max", "first", "last"]), "event_id", hot=True)
    return out.select("event_id", "a_count", F.round("a_sum", 4).alias("a_sum"), "a_min", "a_max", "a_first", "a_last")


@query("trailing_day_of_all", f"SELECT event_id, count(value) OVER w AS w_count, round(sum(value) OVER w, 4) AS w_sum, min(value) OVER w AS w_min, max(value) OVER w AS w_max, round(median(value) OVER w, 6) AS w_median, count(DISTINCT user_id) OVER w AS u_unique FROM events WINDOW w AS {_DAY}")
def trailing_day_of_all(t):
    out = W.running(events(t), W.TimeWindow("w", "value", "ts", "sliding", 86400, functions=["count", "sum", "min", "max", "median"]), "event_id")
    out = W.running(out, W.TimeWindow("u", "user_id", "ts", "global", functions=["unique"], watermark=86400), "event_id")
    return out.select("event_id", "w_count", F.round("w_sum", 4).alias("w_sum"), "w_min", "w_max", r6("w_median").alias("w_median"), big("u_unique").alias("u_unique"))


@query("global_window_of_all", "SELECT event_id, count(value) OVER w AS w_count, round(avg(value) OVER w, 9) AS w_mean, round(coalesce(stddev_samp(value) OVER w, 0), 4) AS w_std, max(value) OVER w AS w_max FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def global_window_of_all(t):
    out = W.running(events(t), W.TimeWindow("w", "value", "ts", "global", functions=["count", "mean", "std", "max"]), "event_id")
    return out.select("event_id", "w_count", F.round("w_mean", 9).alias("w_mean"), F.round("w_std", 4).alias("w_std"), "w_max")


@query("sessions_of_all", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) > INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (ORDER BY ts, event_id) AS s FROM g) SELECT event_id, CAST(s AS BIGINT) AS session, count(value) OVER w AS w_count, round(sum(value) OVER w, 6) AS w_sum FROM s WINDOW w AS (PARTITION BY s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def sessions_of_all(t):
    rows = W.session_ids(events(t), "ts", [], 600, "event_id").withColumnRenamed("_session", "session")
    out = W.running(rows, W.TimeWindow("w", "value", "ts", "session", 600, functions=["count", "sum"]), "event_id")
    return out.select("event_id", "session", "w_count", r6("w_sum").alias("w_sum"))


@query("prequential_of_all", "WITH p AS (SELECT event_id, CASE WHEN (value > 20) IS NOT DISTINCT FROM (user_id % 3 = 0) THEN 1.0 ELSE 0.0 END AS ok FROM events) SELECT event_id, round(avg(ok) OVER w, 6) AS accuracy, count(*) OVER w AS sample_count FROM p WINDOW w AS (ORDER BY event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)")
def prequential_of_all(t):
    rows = t("events").withColumns({"actual": F.col("value") > 20, "predicted": F.col("user_id") % 3 == 0})
    return learning.prequential(rows, "event_id", "actual", "predicted", last=500).select("event_id", r6("accuracy").alias("accuracy"), "sample_count")


_AT = f"(SELECT event_id, v, row_number() OVER (ORDER BY event_id) AS rn, median(v) OVER (ORDER BY event_id) AS m FROM {GAPPY})"


@query("missing_fill_median_online", f"SELECT a.event_id, round(coalesce(a.v, b.m), 6) AS v FROM {_AT} a LEFT JOIN {_AT} b ON b.rn = (a.rn // 100) * 100 AND b.rn > 0")
def missing_fill_median_online(t):
    return missing.impute(gappy(t), ["v"], "fill_median", order="event_id", mode="online").select("event_id", r6("v").alias("v"))


_KINDS = "(SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS k FROM events)"


@query("missing_fill_mode_online", f"""
WITH g AS {_KINDS}, v AS (SELECT rn, k, count(*) OVER (PARTITION BY k ORDER BY rn) AS n, min(rn) OVER (PARTITION BY k) AS f FROM g WHERE trim(k) <> ''),
m AS (SELECT rn // 100 AS mark FROM g WHERE rn % 100 = 0),
b AS (SELECT mark, k FROM (SELECT mark, k, row_number() OVER (PARTITION BY mark ORDER BY n DESC, f) AS place FROM (SELECT mark, k, max(n) AS n, min(f) AS f FROM m JOIN v ON v.rn <= mark * 100 GROUP BY ALL)) WHERE place = 1)
SELECT event_id, CASE WHEN trim(g.k) = '' THEN coalesce(b.k, g.k) ELSE g.k END AS k FROM g LEFT JOIN b ON g.rn // 100 = b.mark
""")
def missing_fill_mode_online(t):
    g = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("k"))
    return missing.impute(g, ["k"], "fill_mode", order="event_id", mode="online").select("event_id", F.coalesce("k", F.lit("  ")).alias("k"))


@query("normalize_online_all", """
WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS rn FROM events),
m AS (SELECT rn // 1000 AS mark FROM e WHERE rn % 1000 = 0),
p AS (SELECT mark, min(value) AS lo, max(value) AS hi, list_sort(list(value)) AS l, count(*) AS n FROM m JOIN e ON e.rn <= mark * 1000 GROUP BY mark),
q AS (SELECT mark, lo, hi, (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2 AS md, l[n // 4 + 1] AS q1, l[3 * n // 4 + 1] AS q3 FROM p)
SELECT event_id, round(CASE WHEN lo IS NULL THEN value ELSE (value - lo) / CASE WHEN hi <> lo THEN hi - lo ELSE 1 END END, 6) AS min_max,
 round(CASE WHEN lo IS NULL THEN value ELSE value / greatest(abs(lo), abs(hi)) END, 6) AS max_abs,
 round(CASE WHEN lo IS NULL THEN value WHEN value + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END > 0 THEN ln(value + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END) ELSE 0 END, 6) AS log,
 round(CASE WHEN lo IS NULL THEN value ELSE (value - md) / greatest(q3 - q1, 1e-8) END, 6) AS robust
FROM e LEFT JOIN q ON e.rn // 1000 = q.mark
""")
def normalize_online_all(t):
    df = t("events").select("event_id", "value")
    names = ("min_max", "max_abs", "log", "robust")
    for s in names:
        df = normalize.online(df, "value", "event_id", s, out=s)
    return df.select("event_id", *[r6(s).alias(s) for s in names])


@query("observed_missing", f"SELECT 'v' AS field, count(*) AS total_rows, count(*) - count(v) AS missing, count(*) - count(v) AS filled, 0::BIGINT AS rejected FROM {GAPPY}")
def observed_missing(t):
    """Statistics from the pass that writes the rows."""
    out = observed.imputed(gappy(t), ["v"], strategy="fill_constant", fill_values={"v": 0.0})
    out.df.write.format("noop").mode("overwrite").save()
    return out.table()


@query("observed_pipeline", "WITH e AS (SELECT value < 1 OR value > 400 AS bad, event_id % 5 = 0 AS twice FROM events), n AS (SELECT count(*) + count(*) FILTER (WHERE twice) AS rows, count(*) FILTER (WHERE twice) AS again, count(*) FILTER (WHERE bad) + count(*) FILTER (WHERE bad AND twice) AS bad, count(*) FILTER (WHERE bad AND twice) AS doubly FROM e) SELECT 'duplicates' AS stage, rows, again AS failed FROM n UNION ALL SELECT 'clean', rows, bad FROM n UNION ALL SELECT 'total', rows, again + bad - doubly FROM n")
def observed_pipeline(t):
    cfg = {"validation": {"duplicate": {"enabled": True, "key_fields": ["event_id"]}}, "transformation": {"data_cleaning": {"enabled": True, "rules": {"value": {"action": "reject", "min_value": 1.0, "max_value": 400.0}}}}}
    e = t("events").select("event_id", "value")
    out = Pipeline.of(cfg, "event_id").observed(e.unionByName(e.where("event_id % 5 = 0")))
    out.df.write.format("noop").mode("overwrite").save()
    return out.table().where("failed > 0")


def _bayes(name: str, recent: int | None) -> str:
    """Predictions of a naive Bayes model of what was seen at the mark before each row, less what was seen ``recent`` marks earlier."""
    sums = {f"{k}{c}{f}": f"{e} FILTER (WHERE {'' if c else 'NOT '}y) OVER w" for c in (0, 1) for f in "ab" for k, e in (("s", f"sum({f})"), ("q", f"sum({f} * {f})"))} | {f"n{c}": f"count(*) FILTER (WHERE {'' if c else 'NOT '}y) OVER w" for c in (0, 1)}
    less = ", ".join(f"m.{k} - coalesce(o.{k}, 0) AS {k}" for k in sums)
    part = lambda c, f: f"(-0.5 * ln(greatest(q{c}{f} / n{c} - (s{c}{f} / n{c}) * (s{c}{f} / n{c}), 1e-9)) - ({f} - s{c}{f} / n{c}) * ({f} - s{c}{f} / n{c}) / (2 * greatest(q{c}{f} / n{c} - (s{c}{f} / n{c}) * (s{c}{f} / n{c}), 1e-9)))"
    odds = f"ln(n1) - ln(n0) + {part(1, 'a')} - {part(0, 'a')} + {part(1, 'b')} - {part(0, 'b')}"
    return f"""
{name}s AS (SELECT rn, {", ".join(f"coalesce({e}, 0)::DOUBLE AS {k}" for k, e in sums.items())} FROM e WINDOW w AS (ORDER BY rn)),
{name}m AS (SELECT rn // 250 AS mark, * FROM {name}s WHERE rn % 250 = 0),
{name}r AS (SELECT m.mark, {less} FROM {name}m m LEFT JOIN {name}m o ON o.mark = m.mark - {recent or 1_000_000_000}),
{name} AS (SELECT e.rn, coalesce(CASE WHEN n0 > 0 AND n1 > 0 THEN {odds} > 0 ELSE n1 > n0 END, false) AS p FROM e LEFT JOIN {name}r r ON (e.rn - 1) // 250 = r.mark)"""


@query("online_model_switched", f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, CASE WHEN event_id % 2000 < 1000 THEN value > 20 ELSE value < 20 END AS y, value AS a, user_id::DOUBLE AS b FROM events),{_bayes("f", None)},{_bayes("g", 2)},
h AS (SELECT e.*, f.p AS whole, g.p AS recent, coalesce(sum((y = f.p)::INT) OVER k, 0) AS hf, coalesce(sum((y = g.p)::INT) OVER k, 0) AS hg FROM e JOIN f USING (rn) JOIN g USING (rn) WINDOW k AS (ORDER BY rn ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
SELECT event_id, whole, recent, CASE WHEN hg > hf THEN 'recent' ELSE 'whole' END AS model, CASE WHEN hg > hf THEN recent ELSE whole END AS expected FROM h""")
def online_model_switched(t):
    """Two models learn as the rows go by, one of them forgets; the one that was right more often of late is asked. What is to be learned changes every thousand rows."""
    y = F.when(F.col("event_id") % 2000 < 1000, F.col("value") > 20).otherwise(F.col("value") < 20)
    df = t("events").select("event_id", "value", "user_id", y.alias("y"))
    df = learning.online_bayes(df, "event_id", "y", ["value", "user_id"], "whole", 250)
    df = learning.online_bayes(df, "event_id", "y", ["value", "user_id"], "recent", 250, recent=2)
    return learning.switched(df, "event_id", "y", ["whole", "recent"], 200).select("event_id", "whole", "recent", "model", "expected")
