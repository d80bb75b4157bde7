"""Schema, cleaning, missing values, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import audit, clean, duplicates, missing, schema
from millrace.plans.queries.base import GAPPY, big, gappy, query, r6

_RAW = "CASE WHEN event_id % 5 = 0 THEN 'abc' WHEN event_id % 3 = 0 THEN concat(CAST(user_id AS VARCHAR), '.0') WHEN event_id % 7 = 0 THEN ' 7 ' WHEN event_id % 11 = 0 THEN '1_000' WHEN event_id % 13 = 0 THEN '2.5' ELSE CAST(user_id AS VARCHAR) END"


def _raw(t):
    return t("events").select("event_id", F.expr(_RAW.replace("VARCHAR", "STRING")).alias("n"), "event_type", "value")


@query("schema_validate", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 7 = 0 THEN 7 WHEN event_id % 11 = 0 THEN 1000 WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS n, NOT (event_id % 5 = 0 OR (event_id % 13 = 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0)) AS is_valid FROM events")
def schema_validate(t):
    out = schema.validate(_raw(t), schema.fields_of([{"name": "event_id", "type": "int"}, {"name": "n", "type": "int"}]))
    return out.select("event_id", "n", F.col(audit.VALID).alias("is_valid"))


@query("schema_project", "SELECT event_id, event_type, value FROM events")
def schema_project(t):
    out = schema.validate(t("events"), schema.fields_of(None, {"event_id": "int", "event_type": "str", "value": "float"}, ["event_id"]))
    return audit.split(out)[0]


@query("schema_required_default", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE o_orderpriority END AS priority, o_orderkey % 9 <> 0 AS is_valid FROM orders")
def schema_required_default(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("price"))
    out = schema.validate(o, schema.fields_of([{"name": "o_orderkey", "type": "int"}, {"name": "priority", "required": False, "default": "none"}, {"name": "price", "type": "float"}]))
    return out.select("o_orderkey", "priority", F.col(audit.VALID).alias("is_valid"))


@query("clean_range_reject", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 5 AND l_quantity <= 45")
def clean_range_reject(t):
    out = clean.clean(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), [clean.Rule("l_quantity", "reject", 5, 45)])
    return audit.split(out)[0]


@query("clean_cap", "SELECT o_orderkey, greatest(least(o_totalprice, 100000.0::DOUBLE), 20000.0::DOUBLE) AS price, o_totalprice < 20000 OR o_totalprice > 100000 AS capped FROM orders")
def clean_cap(t):
    out = clean.clean(t("orders").select("o_orderkey", F.col("o_totalprice").alias("price")), [clean.Rule("price", "cap", 20000.0, 100000.0)])
    return out.select("o_orderkey", "price", (F.size("capped_fields") > 0).alias("capped"))


@query("clean_remove_field", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def clean_remove_field(t):
    out = clean.clean(t("customer").select("c_custkey", "c_acctbal"), [clean.Rule("c_acctbal", "remove_field", 0.0, 9000.0, forbidden_values=[-999.0])])
    return out.select("c_custkey", "c_acctbal")


@query("clean_log_warn", "SELECT o_orderkey, CAST((o_totalprice < 20000)::INT + (o_totalprice > 100000)::INT AS BIGINT) AS n_warnings FROM orders")
def clean_log_warn(t):
    out = clean.clean(t("orders"), [clean.Rule("o_totalprice", "log_warn", 20000.0, 100000.0)])
    return out.select("o_orderkey", big(F.size(audit.WARNINGS)).alias("n_warnings"))


@query("clean_allowed_values", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderstatus IN ('O', 'F')")
def clean_allowed_values(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return audit.split(clean.clean(o, [clean.Rule("o_orderstatus", allowed_values=["O", "F"])]))[0]


@query("clean_forbidden_values", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 6 <> 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def clean_forbidden_values(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return audit.split(clean.clean(c, [clean.Rule("c_mktsegment", forbidden_values=["BUILDING", "MACHINERY", None])]))[0]


@query("clean_pattern", "SELECT page_id FROM pages WHERE regexp_matches(url, '^(?:https?://[a-z0-9.-]+)')")
def clean_pattern(t):
    return audit.split(clean.clean(t("pages").select("page_id", "url"), [clean.Rule("url", pattern=r"https?://[a-z0-9.-]+")]))[0].select("page_id")


@query("sdk_validators", r"SELECT page_id, url IS NOT NULL AND trim(url) <> '' AS v_required, coalesce(length(url) >= 20, false) AS v_min, coalesce(length(url) <= 60, false) AS v_max, coalesce(page_id >= 5 AND page_id <= 500, false) AS v_range, coalesce(regexp_matches(url, '^https?://.+'), false) AS v_url, coalesce(regexp_matches(url, '^[^@]+@[^@]+\.[^@]+$'), false) AS v_email, coalesce(page_id IN (1, 2, 3), false) AS v_one_of, coalesce(regexp_matches(url, '^(?:http)'), false) AS v_pattern FROM pages")
def sdk_validators(t):
    u, p = F.col("url"), F.col("page_id")
    v = S.validator
    return t("pages").select(
        "page_id", v("required", u).alias("v_required"), v("min_length", u, 20).alias("v_min"), v("max_length", u, 60).alias("v_max"), v("range", p, 5, 500).alias("v_range"),
        v("url", u).alias("v_url"), v("email", u).alias("v_email"), v("one_of", p, [1, 2, 3]).alias("v_one_of"), v("pattern", u, "http").alias("v_pattern"),
    )


@query("missing_reject", f"SELECT event_id, v FROM {GAPPY} WHERE v IS NOT NULL")
def missing_reject(t):
    return audit.split(missing.impute(gappy(t), ["v"], "reject"))[0].select("event_id", "v")


@query("missing_fill_constant", f"SELECT event_id, coalesce(v, -1.0::DOUBLE) AS v FROM {GAPPY}")
def missing_fill_constant(t):
    return missing.impute(gappy(t), ["v"], "fill_constant", {"v": -1.0}).select("event_id", "v")


@query("missing_fill_mean", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {GAPPY})), 6) AS v FROM {GAPPY}")
def missing_fill_mean(t):
    return missing.impute(gappy(t), ["v"], "fill_mean").select("event_id", r6("v").alias("v"))


_SEEN = f"(SELECT event_id, v, row_number() OVER (ORDER BY event_id) AS rn, sum(v) OVER (ORDER BY event_id) AS s, count(v) OVER (ORDER BY event_id) AS n FROM {GAPPY})"


@query("missing_fill_mean_online", f"SELECT a.event_id, round(coalesce(a.v, b.s / b.n), 6) AS v FROM {_SEEN} a LEFT JOIN {_SEEN} b ON b.rn = (a.rn // 100) * 100 AND b.rn > 0")
def missing_fill_mean_online(t):
    return missing.impute(gappy(t), ["v"], "fill_mean", order="event_id", mode="online").select("event_id", r6("v").alias("v"))


@query("missing_fill_median", f"SELECT event_id, round(coalesce(v, (SELECT median(v) FROM {GAPPY})), 6) AS v FROM {GAPPY}")
def missing_fill_median(t):
    return missing.impute(gappy(t), ["v"], "fill_median").select("event_id", r6("v").alias("v"))


@query("missing_fill_mode", "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS k FROM events), m AS (SELECT k FROM g WHERE trim(k) <> '' GROUP BY k ORDER BY count(*) DESC, min(event_id) LIMIT 1) SELECT event_id, CASE WHEN trim(k) = '' THEN (SELECT k FROM m) ELSE k END AS k FROM g")
def missing_fill_mode(t):
    g = t("events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("k"))
    return missing.impute(g, ["k"], "fill_mode", order="event_id").select("event_id", "k")


@query("missing_fill_forward", f"SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM {GAPPY}")
def missing_fill_forward(t):
    return missing.impute(gappy(t), ["v"], "fill_forward", order="event_id").select("event_id", "v")


@query("missing_fill_forward_by_user", f"SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM {GAPPY}")
def missing_fill_forward_by_user(t):
    return missing.impute(gappy(t), ["v"], "fill_forward", order="event_id", partition_by=["user_id"]).select("event_id", "v")


@query("missing_fill_backward", f"SELECT event_id, coalesce(v, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS v FROM {GAPPY}")
def missing_fill_backward(t):
    return missing.impute(gappy(t), ["v"], "fill_backward", order="event_id").select("event_id", "v")


@query("missing_required", f"SELECT event_id, v IS NOT NULL AS is_valid FROM {GAPPY}")
def missing_required(t):
    return missing.impute(gappy(t), ["event_type"], "fill_constant", required=["v"]).select("event_id", F.col(audit.VALID).alias("is_valid"))


@query("missing_stats", f"SELECT 'v' AS field, count(*) AS total_rows, count(*) - count(v) AS missing FROM {GAPPY} UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type) FROM {GAPPY}")
def missing_stats(t):
    return missing.stats(gappy(t), ["v", "event_type"])


@query("missing_field_config", f"SELECT event_id, coalesce(v, 0.5::DOUBLE) AS v, event_type FROM {GAPPY}")
def missing_field_config(t):
    return missing.impute(gappy(t), ["v", "event_type"], "reject", field_config={"v": {"strategy": "fill_constant", "value": 0.5}}).select("event_id", "v", "event_type")


_FIRST = "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL"


@query("dedup_reject", _FIRST)
def dedup_reject(t):
    return audit.split(duplicates.dedup(t("events"), "event_id", ["user_id", "event_type"]))[0].select("user_id", "event_type", "event_id")


@query("dedup_keep_first", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_keep_first(t):
    return audit.split(duplicates.dedup(t("events"), "event_id", ["user_id", "event_type"], "keep_first"))[0].select("user_id", "event_type", "event_id", "value")


@query("dedup_keep_last", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedup_keep_last(t):
    return audit.split(duplicates.dedup(t("events"), "event_id", ["user_id", "event_type"], "keep_last"))[0].select("user_id", "event_type", "event_id", "value")


@query("dedup_mark", "WITH f AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) SELECT event_id, event_id <> f AS is_duplicate, CASE WHEN event_id <> f THEN f END AS first_seen FROM f")
def dedup_mark(t):
    return duplicates.dedup(t("events"), "event_id", ["user_id", "event_type"], "mark").select("event_id", F.col("_is_duplicate").alias("is_duplicate"), F.col("_first_seen_index").alias("first_seen"))


@query("dedup_full_row", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source, n_chars")
def dedup_full_row(t):
    return audit.split(duplicates.dedup(t("documents"), "doc_id"))[0].select("doc_id")


def repeated(t):
    """``events`` with every third row delivered once more and every ninth twice more."""
    e = t("events")
    return e.unionByName(e.where("event_id % 3 = 0")).unionByName(e.where("event_id % 9 = 0"))


REPEATED = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0 UNION ALL SELECT * FROM events WHERE event_id % 9 = 0)"


@query("dedup_delivered_again", "SELECT event_id, user_id, event_type, value FROM events")
def dedup_delivered_again(t):
    return audit.split(duplicates.dedup(repeated(t), "event_id", ["event_id"]))[0].select("event_id", "user_id", "event_type", "value")


@query("dedup_whole_rows_again", "SELECT event_id, count(*) AS n FROM events GROUP BY event_id")
def dedup_whole_rows_again(t):
    kept = audit.split(duplicates.dedup(repeated(t).withColumn("arrival", F.lit(0)), "arrival"))[0]
    return kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_tied_order", f"SELECT user_id, event_type, max(CASE WHEN event_id % 4 <> 0 THEN event_id // 50 END) AS tied, count(*) AS copies FROM {REPEATED} GROUP BY ALL")
def dedup_tied_order(t):
    """The order column ties and is null in places; one row of each key stays, and as many are counted as there were."""
    rows = repeated(t).withColumn("tied", F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 50)))
    out = duplicates.dedup(rows, "tied", ["user_id", "event_type"], "keep_last")
    copies = out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))
    return out.where(audit.VALID).select("user_id", "event_type", big("tied").alias("tied")).join(copies, ["user_id", "event_type"])


@query("dedup_again_ledger", f"SELECT '_duplicate' AS field, 'duplicate_row' AS error, event_id, count(*) - 1 AS n FROM {REPEATED} GROUP BY event_id HAVING count(*) > 1")
def dedup_again_ledger(t):
    rejected = audit.ledger(duplicates.dedup(repeated(t), "event_id", ["event_id"]), "event_id")
    return rejected.groupBy("field", "error", "event_id").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_again_mark", f"WITH r AS (SELECT user_id, event_type, event_id FROM {REPEATED}) SELECT user_id, event_type, min(event_id) AS first_seen, count(*) - 1 AS marked FROM r GROUP BY ALL HAVING count(*) > 1")
def dedup_again_mark(t):
    marked = duplicates.dedup(repeated(t), "event_id", ["user_id", "event_type"], "mark").where("_is_duplicate")
    return marked.groupBy("user_id", "event_type").agg(F.min("_first_seen_index").alias("first_seen"), F.count(F.lit(1)).alias("marked"))


@query("dedup_stats", "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text) SELECT count(*) AS unique_keys, CAST(sum(n - 1) AS BIGINT) AS total_duplicates, count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM g")
def dedup_stats(t):
    return duplicates.stats(t("documents"), ["text"]).select("unique_keys", big("total_duplicates").alias("total_duplicates"), "duplicate_groups")
