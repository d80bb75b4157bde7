"""Modes and options of the stages: strictness, scoping, formats, dependencies, several configurations at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.operators import clean, convert, features, missing, schema
from millrace.plans.pipeline import Pipeline
from millrace.plans.queries.base import GAPPY, big, events, gappy, query, r6


@query("schema_strict", "SELECT event_id, user_id FROM events")
def schema_strict(t):
    return schema.validate(t("events"), schema.fields_of(field_types={"event_id": "int", "user_id": "int"}, required=["event_id"]), strict=True).select("event_id", "user_id")


@query("rule_scoping", "SELECT o_orderkey, o_totalprice <= 100000 AS valid FROM orders")
def rule_scoping(t):
    """A rule for a column that isn't there does nothing; of two rules for one column the last counts."""
    rules = [clean.Rule("no_such_column", "reject", 0.0, 1.0), clean.Rule("o_totalprice", "reject", 1e9), clean.Rule("o_totalprice", "reject", None, 100000.0)]
    return clean.clean(t("orders"), rules).select("o_orderkey", F.col("_valid").alias("valid"))


_TWO = {"transformation": {"data_cleaning": {"enabled": True, "rules": {"o_totalprice": {"max_value": 100000.0}}}, "type_conversion": {"enabled": True, "type_mapping": {"o_orderstatus": "int"}}}}


@query("errors_accumulate", "SELECT o_orderkey, 1 + CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END::BIGINT AS n_errors FROM orders")
def errors_accumulate(t):
    p = Pipeline.of(_TWO, "o_orderkey")
    return p.apply(t("orders")).select("o_orderkey", big(F.size("_errors")).alias("n_errors"))


@query("strict_short_circuit", "SELECT o_orderkey, 1::BIGINT AS n_errors FROM orders")
def strict_short_circuit(t):
    p = Pipeline.of(_TWO, "o_orderkey", overrides={"strict_mode": True})
    return p.apply(t("orders")).select("o_orderkey", big(F.size("_errors")).alias("n_errors"))


@query("shared_action", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def shared_action(t):
    return clean.clean(t("orders"), [clean.Rule("o_totalprice", max_value=100000.0)], action="remove_field").select("o_orderkey", "o_totalprice")


@query("cast_str", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM events")
def cast_str(t):
    e = t("events").select("event_id", "user_id", (F.col("user_id") % 2 == 0).alias("even"))
    return convert.convert(e, {"user_id": "str", "even": "str"}).select("event_id", "user_id", "even")


@query("cast_auto_target", "SELECT event_id, user_id AS u, event_type AS k FROM events")
def cast_auto_target(t):
    e = t("events").select("event_id", F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("k"))
    return convert.convert(e, {"u": "auto", "k": "auto"}).select("event_id", "u", "k")


@query("cast_custom_formats", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id % 2 = 0 AS flag FROM events")
def cast_custom_formats(t):
    e = events(t).select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("day"), F.when(F.col("user_id") % 2 == 0, "oui").otherwise("non").alias("flag"))
    out = convert.convert(e, {"day": "datetime", "flag": "bool"}, formats=["%d.%m.%Y"], true_words=["oui"], false_words=["non"])
    return out.select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "flag")


_MIXED = "CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '1.5' WHEN 2 THEN 'yes' WHEN 3 THEN '2024-01-02' ELSE event_type END"


@query("cast_infer_each_value", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'datetime' ELSE 'string' END AS type, CASE WHEN event_id % 5 = 0 THEN user_id END AS as_int, {_MIXED} AS text FROM events")
def cast_infer_each_value(t):
    e = t("events").select("event_id", F.expr(_MIXED.replace("VARCHAR", "STRING")).alias("text"))
    got = e.withColumn("x", K.inferred_value(F.col("text")))
    return got.select("event_id", F.col("x.type").alias("type"), F.col("x.int").alias("as_int"), "text")


@query("feature_dependencies", "SELECT event_id, false AS valid, 'missing_dependency nowhere' AS error, CAST(trunc(value * 2) AS BIGINT) AS twice FROM events")
def feature_dependencies(t):
    """A feature whose column is missing is an error of every row; the others keep the values before it."""
    out = features.build(features.build(t("events"), [features.Feature("twice", "arithmetic", "value * 2", ["value"], output_type="int")]), [features.Feature("lost", "arithmetic", "nowhere + 1", ["nowhere"])])
    return out.select("event_id", F.col("_valid").alias("valid"), F.col("_errors")[0]["error"].alias("error"), "twice")


@query("missing_filled", f"SELECT 'v' AS field, count(*) AS total_rows, count(*) - count(v) AS missing, count(*) - count(v) AS filled, 0::BIGINT AS rejected FROM {GAPPY} g")
def missing_filled(t):
    e = gappy(t)
    return missing.stats(e, ["v"], missing.impute(e, ["v"], "fill_constant", {"v": 0.0}))


_MANY = {"features": {"aggregation": {"enabled": True, "aggregations": [
    {"name": "u", "source_field": "value", "group_by": ["user_id"], "functions": ["count", "max"]}, {"name": "k", "source_field": "value", "group_by": ["event_type"], "functions": ["sum", "median"]}]}}}


@query("agg_several_configs", "SELECT event_id, count(value) OVER u AS u_count, max(value) OVER u AS u_max, round(sum(value) OVER k, 5) AS k_sum, round(median(value) OVER k, 6) AS k_median FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def agg_several_configs(t):
    out = Pipeline.of(_MANY, "event_id").accepted(t("events"))
    return out.select("event_id", "u_count", "u_max", F.round("k_sum", 5).alias("k_sum"), r6("k_median").alias("k_median"))


@query("pipeline_stage_totals", "SELECT 'clean' AS stage, (SELECT count(*) FROM orders) AS rows, count(*) AS failed FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'convert', count(*), count(*) FROM orders UNION ALL SELECT 'total', count(*), count(*) FROM orders")
def pipeline_stage_totals(t):
    return Pipeline.of(_TWO, "o_orderkey").stats(t("orders"))
