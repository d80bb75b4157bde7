"""Features, aggregations, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import aggregates as A
from millrace.operators import features as X
from millrace.operators import windows as W
from millrace.plans.queries.base import big, events, query, r6


def _feature(t, table, keys, expression, kind="arithmetic"):
    return X.build(t(table), [X.Feature("v", kind, expression)]).select(*keys, r6("v").alias("v"))


LK = ["l_orderkey", "l_linenumber"]


@query("feature_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) + power(l_linenumber, 2) - floor(l_quantity / 7) + (l_quantity - 5 * floor(l_quantity / 5)), 6) AS v FROM lineitem")
def feature_arithmetic(t):
    return _feature(t, "lineitem", LK, "l_extendedprice * (1 - l_discount) * (1 + l_tax) + l_linenumber ** 2 - l_quantity // 7 + l_quantity % 5 + unknown_name")


@query("feature_arithmetic_safe_div", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS v FROM lineitem")
def feature_arithmetic_safe_div(t):
    return _feature(t, "lineitem", LK, "l_tax / l_discount")


@query("feature_interaction", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 6) AS v FROM lineitem")
def feature_interaction(t):
    return _feature(t, "lineitem", LK, "l_quantity * l_extendedprice", "interaction")


@query("feature_conditional_ternary", "SELECT o_orderkey, round(CASE WHEN o_totalprice > 100000 THEN o_totalprice * 0.9 ELSE o_totalprice END, 6) AS v FROM orders")
def feature_conditional_ternary(t):
    return _feature(t, "orders", ["o_orderkey"], "o_totalprice > 100000 ? o_totalprice * 0.9 : o_totalprice", "conditional")


@query("feature_conditional_if", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 AND NOT o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM orders")
def feature_conditional_if(t):
    return _feature(t, "orders", ["o_orderkey"], "IF o_totalprice > 50000 and not o_orderkey % 2 == 0 THEN 1 ELSE 0", "conditional")


_PARTS = {"hour": "hour(ts)", "day": "day(ts)", "month": "month(ts)", "year": "year(ts)", "weekday": "isodow(ts) - 1", "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END", "quarter": "quarter(ts)", "day_of_year": "dayofyear(ts)", "week_of_year": "week(ts)", "is_month_start": "CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END", "is_month_end": "CASE WHEN day(ts) = 28 THEN 1 ELSE 0 END"}


@query("feature_datetime", "SELECT event_id, " + ", ".join(f"CAST({v} AS BIGINT) AS f_{k}" for k, v in _PARTS.items()) + " FROM events")
def feature_datetime(t):
    out = X.build(events(t), [X.Feature(f"f_{k}", "datetime", k, column="ts", output_type="int") for k in _PARTS])
    return out.select("event_id", *[f"f_{k}" for k in _PARTS])


_TEXT = {
    "length": "length(text)", "word_count": r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))", "char_count": "length(replace(text, ' ', ''))",
    "uppercase_count": r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))", "digit_count": r"length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))", "special_char_count": r"length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g'))",
}


@query("feature_text", "SELECT doc_id, " + ", ".join(f"CAST({v} AS BIGINT) AS f_{k}" for k, v in _TEXT.items()) + " FROM documents")
def feature_text(t):
    out = X.build(t("documents"), [X.Feature(f"f_{k}", "text", k, column="text", output_type="int") for k in _TEXT])
    return out.select("doc_id", *[f"f_{k}" for k in _TEXT])


@query("feature_custom", "SELECT event_id, round(ln(1 + value), 6) AS v FROM events")
def feature_custom(t):
    return X.build(t("events"), [X.Feature("v", "custom", custom=lambda _: F.log1p("value"))]).select("event_id", r6("v").alias("v"))


@query("json_props_extract", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '-1') AS BIGINT) AS k FROM events")
def json_props_extract(t):
    return t("events").select("event_id", S.json_path(F.col("props"), ["k"], F.lit("-1")).cast("bigint").alias("k"))


@query("text_truncate", "SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 37), '...') ELSE text END AS t FROM documents")
def text_truncate(t):
    return t("documents").select("doc_id", S.truncated(F.col("text"), 40).alias("t"))


@query("group_key_string", "SELECT event_id, concat('user_id=', CAST(user_id AS VARCHAR), '|event_type=', event_type) AS k FROM events")
def group_key_string(t):
    return t("events").select("event_id", S.group_key(["user_id", "event_type"]).alias("k"))


@query("map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS x, 'c' AS y FROM events")
def map_merge(t):
    left = F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("c"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("x"), F.lit("b"))).otherwise(F.create_map().cast("map<string,string>"))
    m = S.merged(left, right)
    return t("events").select("event_id", m["x"].alias("x"), m["y"].alias("y"))


_W = "OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query("agg_running_count", f"SELECT event_id, count(value) {_W} AS a_count, round(sum(value) {_W}, 6) AS a_sum, round(avg(value) {_W}, 9) AS a_mean, min(value) {_W} AS a_min, max(value) {_W} AS a_max FROM events")
def agg_running_count(t):
    out = A.running(t("events"), A.Aggregation("a", "value", ["user_id"], ["count", "sum", "mean", "min", "max"]), "event_id")
    return out.select("event_id", "a_count", r6("a_sum").alias("a_sum"), F.round("a_mean", 9).alias("a_mean"), "a_min", "a_max")


@query("agg_group_basic", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS a_count, round(sum(l_quantity), 4) AS a_sum, round(avg(l_quantity), 6) AS a_mean, min(l_quantity) AS a_min, max(l_quantity) AS a_max FROM lineitem GROUP BY ALL")
def agg_group_basic(t):
    out = A.grouped(t("lineitem"), A.Aggregation("a", "l_quantity", ["l_returnflag", "l_linestatus"], ["count", "sum", "mean", "min", "max"]), "l_orderkey")
    return out.select("l_returnflag", "l_linestatus", "a_count", F.round("a_sum", 4).alias("a_sum"), r6("a_mean").alias("a_mean"), "a_min", "a_max")


@query("agg_std_var", f"SELECT event_id, round(stddev_pop(value) {_W}, 5) AS a_std, CAST(CAST(var_pop(value) {_W} AS FLOAT) AS DOUBLE) AS a_var FROM events")
def agg_std_var(t):
    out = A.running(t("events"), A.Aggregation("a", "value", ["user_id"], ["std", "var"]), "event_id")
    return out.select("event_id", F.round("a_std", 5).alias("a_std"), F.col("a_var").cast("float").cast("double").alias("a_var"))  # to single precision: decimal halves are no ties there


@query("agg_first_last", f"SELECT event_id, first_value(value) {_W} AS a_first, last_value(value) {_W} AS a_last FROM events")
def agg_first_last(t):
    return A.running(t("events"), A.Aggregation("a", "value", ["user_id"], ["first", "last"]), "event_id").select("event_id", "a_first", "a_last")


@query("agg_median", "SELECT event_type, round(median(value), 6) AS a_median FROM events GROUP BY ALL")
def agg_median(t):
    return A.grouped(t("events"), A.Aggregation("a", "value", ["event_type"], ["median"]), "event_id").select("event_type", r6("a_median").alias("a_median"))


@query("agg_running_median", "SELECT event_id, round(median(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS a_median FROM events")
def agg_running_median(t):
    return A.running(t("events"), A.Aggregation("a", "value", ["user_id", "event_type"], ["median"]), "event_id").select("event_id", r6("a_median").alias("a_median"))


_P = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("agg_percentiles", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"list_sort(list(l_extendedprice))[CAST(floor(count(*) * CAST({p} AS DOUBLE)) AS INT) + 1] AS a_{k}" for k, p in _P.items()) + " FROM lineitem GROUP BY ALL")
def agg_percentiles(t):
    return A.grouped(t("lineitem"), A.Aggregation("a", "l_extendedprice", ["l_returnflag", "l_linestatus"], list(_P)), "l_orderkey")


@query("agg_running_percentiles", "SELECT event_id, " + ", ".join(f"list_sort(list(value) OVER w)[CAST(floor(count(*) OVER w * CAST({p} AS DOUBLE)) AS INT) + 1] AS a_{k}" for k, p in _P.items()) + " FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def agg_running_percentiles(t):
    out = A.running(t("events"), A.Aggregation("a", "value", ["user_id", "event_type"], list(_P)), "event_id")
    return out.select("event_id", *[f"a_{k}" for k in _P])


@query("agg_rate", "WITH w AS (SELECT event_id, count(*) OVER w AS n, epoch_us(ts) / 1e6 AS t, first_value(epoch_us(ts)) OVER w / 1e6 AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, round(CASE WHEN n < 2 THEN 0 WHEN t - f <= 0 THEN n ELSE n / ((t - f) / 60) END, 6) AS a_rate FROM w")
def agg_rate(t):
    return A.running(events(t), A.Aggregation("a", "value", ["user_id"], ["rate"], "ts"), "event_id").select("event_id", r6("a_rate").alias("a_rate"))


@query("agg_rate_windowed", "WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n, count(*) OVER k AS kept, epoch_us(ts) / 1e6 AS t, min(epoch_us(ts)) OVER k / 1e6 AS f FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN kept < 2 THEN 0 WHEN t - f <= 0 THEN n ELSE n / ((t - f) / 60) END, 6) AS a_rate FROM w")
def agg_rate_windowed(t):
    out = A.running(events(t), A.Aggregation("a", "value", ["user_id"], ["rate"], "ts", W.duration("6 hours")), "event_id")
    return out.select("event_id", r6("a_rate").alias("a_rate"))


@query("agg_unique", "SELECT user_id, count(DISTINCT event_type) AS a_unique FROM events GROUP BY ALL")
def agg_unique(t):
    return A.grouped(t("events"), A.Aggregation("a", "event_type", ["user_id"], ["unique"]), "event_id")


@query("agg_top_k", "WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT event_type, user_id, n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) AS BIGINT) AS place FROM c QUALIFY place <= 5")
def agg_top_k(t):
    return A.top_k(t("events"), ["event_type"], "user_id", "event_id").select("event_type", "user_id", "n", big("place").alias("place"))


_G = "OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


@query("agg_global", f"SELECT event_id, count(value) {_G} AS a_count, round(sum(value) {_G}, 4) AS a_sum, round(avg(value) {_G}, 9) AS a_mean, min(value) {_G} AS a_min, max(value) {_G} AS a_max, round(stddev_pop(value) {_G}, 4) AS a_std FROM events")
def agg_global(t):
    out = A.running(t("events"), A.Aggregation("a", "value", [], ["count", "sum", "mean", "min", "max", "std"]), "event_id")
    return out.select("event_id", big("a_count").alias("a_count"), F.round("a_sum", 4).alias("a_sum"), F.round("a_mean", 9).alias("a_mean"), "a_min", "a_max", F.round("a_std", 4).alias("a_std"))


@query("agg_multi_key", "SELECT user_id, event_type, count(value) AS a_count, round(sum(value), 6) AS a_sum, round(coalesce(stddev_pop(value), 0), 6) AS a_std, arg_min(value, event_id) AS a_first, arg_max(value, event_id) AS a_last FROM events GROUP BY ALL")
def agg_multi_key(t):
    out = A.grouped(t("events"), A.Aggregation("a", "value", ["user_id", "event_type"], ["count", "sum", "std", "first", "last"]), "event_id")
    return out.select("user_id", "event_type", "a_count", r6("a_sum").alias("a_sum"), r6("a_std").alias("a_std"), "a_first", "a_last")


@query("agg_emit_on_change", f"WITH r AS (SELECT event_id, user_id, max(value) {_W} AS a_max FROM events) SELECT event_id, user_id, a_max FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 OR a_max IS DISTINCT FROM lag(a_max) OVER (PARTITION BY user_id ORDER BY event_id)")
def agg_emit_on_change(t):
    out = A.running(t("events"), A.Aggregation("a", "value", ["user_id"], ["max"]), "event_id")
    return A.on_change(out, ["user_id"], "event_id", "a_max").select("event_id", "user_id", "a_max")


@query("agg_active_groups", "SELECT count(DISTINCT user_id) AS active_groups FROM events")
def agg_active_groups(t):
    return t("events").agg(F.count_distinct("user_id").alias("active_groups"))


def _window(t, functions, **options):
    w = W.TimeWindow("w", "value", "ts", functions=functions, group_by=["user_id"], **options)
    places = {"mean": 9}
    shown = lambda f: big(f"w_{f}") if f in ("count", "unique") else F.col(f"w_{f}").cast("float").cast("double") if f == "var" else F.round(F.col(f"w_{f}"), places.get(f, 6))
    return W.running(events(t), w, "event_id").select("event_id", *[shown(f).alias(f"w_{f}") for f in functions])


def _frame(frame: str, functions=("count", "sum", "mean", "min", "max", "std", "first", "last"), source="events") -> str:
    sql = {"count": "count(value)", "sum": "round(sum(value) OVER w, 6)", "mean": "round(avg(value) OVER w, 9)", "min": "round(min(value) OVER w, 6)", "max": "round(max(value) OVER w, 6)", "std": "round(coalesce(stddev_samp(value) OVER w, 0), 6)", "var": "CAST(CAST(coalesce(var_samp(value) OVER w, 0) AS FLOAT) AS DOUBLE)", "first": "round(first_value(value) OVER w, 6)", "last": "round(last_value(value) OVER w, 6)"}
    cols = ", ".join(f"{sql[f] if f != 'count' else 'count(value) OVER w'} AS w_{f}" for f in functions)
    return f"SELECT event_id, {cols} FROM {source} WINDOW w AS ({frame})"


_ALL = ["count", "sum", "mean", "min", "max", "std", "first", "last"]
_FRAME_TUMBLE = "PARTITION BY user_id, time_bucket(INTERVAL 7 HOUR, ts, TIMESTAMP '1970-01-01') ORDER BY event_id ROWS UNBOUNDED PRECEDING"


@query("window_tumbling_running", _frame(_FRAME_TUMBLE))
def window_tumbling_running(t):
    return _window(t, _ALL, type="tumbling", size=7 * 3600)


@query("window_tumbling_final", "SELECT strftime(time_bucket(INTERVAL 7 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS w_count, round(sum(value), 6) AS w_sum, round(coalesce(stddev_samp(value), 0), 6) AS w_std FROM events GROUP BY ALL")
def window_tumbling_final(t):
    out = W.closed(events(t), W.TimeWindow("w", "value", "ts", "tumbling", W.duration("7 hours"), functions=["count", "sum", "std"], group_by=["event_type"]))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "w_count", r6("w_sum").alias("w_sum"), r6("w_std").alias("w_std"))


@query("window_sliding_trailing", _frame("PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW"))
def window_sliding_trailing(t):
    return _window(t, _ALL, type="sliding", size=3600)


@query("window_hopping", "WITH h AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS w_count, round(avg(value), 6) AS w_mean FROM h GROUP BY ALL")
def window_hopping(t):
    out = W.closed(events(t), W.TimeWindow("w", "value", "ts", "sliding", W.duration("6 hours"), W.duration("2 hours"), ["count", "mean"], ["event_type"]))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "w_count", r6("w_mean").alias("w_mean"))


_SESS = "(SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS n FROM events))"


@query("window_session_running", _frame("PARTITION BY user_id, s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING", ("count", "sum", "mean"), _SESS + " AS q"))
def window_session_running(t):
    return _window(t, ["count", "sum", "mean"], type="session", size=12 * 3600)


@query("window_session_final", f"SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(value) AS w_count, round(sum(value), 6) AS w_sum FROM {_SESS} AS q GROUP BY user_id, s")
def window_session_final(t):
    out = W.closed(events(t), W.TimeWindow("w", "value", "ts", "session", 12 * 3600, functions=["count", "sum"], group_by=["user_id"]))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "user_id", "w_count", r6("w_sum").alias("w_sum"))


@query("window_global", _frame("PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING", ("count", "sum", "mean", "std", "var")))
def window_global(t):
    return _window(t, ["count", "sum", "mean", "std", "var"], type="global")


@query("window_global_horizon", _frame("PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW", ("count", "mean")))
def window_global_horizon(t):
    return _window(t, ["count", "mean"], type="global", watermark=86400)


@query("window_percentiles", "SELECT event_id, round(median(value) OVER w, 6) AS w_median, " + ", ".join(f"round(list_sort(list(value) OVER w)[least(CAST(floor(count(*) OVER w * CAST({p} AS DOUBLE)) AS INT), (count(*) OVER w)::INT - 1) + 1], 6) AS w_{k}" for k, p in _P.items()) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
def window_percentiles(t):
    return _window(t, ["median", *_P], type="sliding", size=86400)


@query("window_unique", "SELECT event_id, count(DISTINCT value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS w_unique FROM events")
def window_unique(t):
    return _window(t, ["unique"], type="sliding", size=86400)


@query("window_rate", "WITH w AS (SELECT event_id, count(*) OVER w AS n, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 6e7 AS span FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN n < 2 THEN 0 WHEN span <= 0 THEN n ELSE n / span END, 6) AS w_rate FROM w")
def window_rate(t):
    return _window(t, ["rate"], type="sliding", size=86400)
