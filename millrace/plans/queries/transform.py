"""Conversion, encoding, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.operators import audit, convert, encode, normalize
from millrace.plans.queries.base import big, query, r6

_NUM = "CASE event_id % 8 WHEN 0 THEN 'abc' WHEN 1 THEN '1.9' WHEN 2 THEN '-1.9' WHEN 3 THEN concat(' ', CAST(value AS VARCHAR)) WHEN 4 THEN 'nan' WHEN 5 THEN '1e3' WHEN 6 THEN NULL ELSE CAST(event_id AS VARCHAR) END"
_FLOAT = "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 1.9::DOUBLE WHEN 2 THEN -1.9::DOUBLE WHEN 3 THEN value WHEN 4 THEN NULL WHEN 5 THEN 1000.0::DOUBLE WHEN 6 THEN NULL ELSE CAST(event_id AS DOUBLE) END"


def _numbers(t):
    e = t("events")
    fixed = F.when(F.col("event_id") % 8 == 3, F.concat(F.lit(" "), F.col("value").cast("string")))
    return e.select("event_id", F.coalesce(fixed, F.expr(_NUM.replace("VARCHAR", "STRING"))).alias("s"))


@query("cast_int", f"SELECT event_id, CAST(trunc({_FLOAT}) AS BIGINT) AS v FROM events")
def cast_int(t):
    return convert.convert(_numbers(t), {"s": "int"}).select("event_id", F.col("s").alias("v"))


@query("cast_float", f"SELECT event_id, CASE WHEN event_id % 8 = 4 THEN -7.0::DOUBLE ELSE {_FLOAT} END AS v FROM events")
def cast_float(t):
    out = convert.convert(_numbers(t), {"s": "float"})
    return out.select("event_id", F.when(F.isnan("s"), F.lit(-7.0)).otherwise(F.col("s")).alias("v"))


@query("cast_bool", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL WHEN 4 THEN false ELSE NULL END AS v FROM events")
def cast_bool(t):
    s = F.expr("CASE event_id % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'off' WHEN 2 THEN 'T' WHEN 3 THEN 'maybe' WHEN 4 THEN '0' ELSE NULL END")
    return convert.convert(t("events").select("event_id", s.alias("v")), {"v": "bool"}).select("event_id", "v")


@query("cast_datetime", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') WHEN 5 THEN NULL WHEN 3 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') WHEN 4 THEN '2024-04-13 00:00:00' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS v FROM events")
def cast_datetime(t):
    s = F.expr("CASE event_id % 6 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 3 THEN date_format(ts, 'd/M/yyyy') WHEN 4 THEN '04/13/2024' ELSE 'soon' END")
    out = convert.convert(t("events").select("event_id", s.alias("v")), {"v": "datetime"})
    return out.select("event_id", F.date_format("v", "yyyy-MM-dd HH:mm:ss").alias("v"))


@query("cast_auto_infer", "SELECT event_id, CAST(event_id AS BIGINT) AS a, CAST(value AS DOUBLE) AS b, event_id % 2 = 0 AS c, strftime(ts, '%Y-%m-%d') AS d, event_type AS e FROM events")
def cast_auto_infer(t):
    e = t("events").select("event_id", F.col("event_id").cast("string").alias("a"), F.col("value").cast("string").alias("b"), F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("c"), F.date_format("ts", "yyyy-MM-dd").alias("d"), F.col("event_type").alias("e"))
    out = convert.convert(e, auto_infer=True)
    return out.select("event_id", "a", "b", "c", F.date_format("d", "yyyy-MM-dd").alias("d"), "e")


@query("cast_errors", "SELECT event_id, 's' AS field, 'not_int' AS error, CASE event_id % 8 WHEN 0 THEN 'abc' ELSE 'nan' END AS value FROM events WHERE event_id % 8 IN (0, 4)")
def cast_errors(t):
    return audit.ledger(convert.convert(_numbers(t), {"s": "int"}), "event_id").select("event_id", "field", "error", "value")


@query("cast_stats", f"SELECT 's' AS field, 'int' AS type, count({_FLOAT}) AS converted, count(*) FILTER (WHERE event_id % 8 IN (0, 4)) AS errors FROM events")
def cast_stats(t):
    return convert.stats(_numbers(t), {"s": "int"})


_CODES = "(SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) - 1 AS code, count(*) AS n FROM events GROUP BY event_type)"


def _encoded(t, strategy, **options):
    e = t("events").select("event_id", "event_type", "value")
    return encode.Encoder(["event_type"], strategy, **options).fit(e, "event_id").transform(e)


@query("encode_label", f"SELECT event_id, CAST(code AS BIGINT) AS code FROM events JOIN {_CODES} c USING (event_type)")
def encode_label(t):
    return _encoded(t, "label").select("event_id", big("event_type").alias("code"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("encode_one_hot", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{x}' AS BIGINT) AS is_{x}" for x in _TYPES) + " FROM events")
def encode_one_hot(t):
    return _encoded(t, "one_hot").select("event_id", *[big(f"event_type_{x}").alias(f"is_{x}") for x in _TYPES])


@query("encode_one_hot_drop_first", f"SELECT event_id, CAST((c.code > 0) AS BIGINT) AS bits, CAST((SELECT count(*) - 1 FROM {_CODES}) AS BIGINT) AS n_columns FROM events JOIN {_CODES} c USING (event_type)")
def encode_one_hot_drop_first(t):
    out = _encoded(t, "one_hot", drop_first=True)
    made = [c for c in out.columns if c.startswith("event_type_")]
    return out.select("event_id", big(sum((F.col(c) for c in made), F.lit(0))).alias("bits"), F.lit(len(made)).cast("bigint").alias("n_columns"))


@query("encode_ordinal", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END::BIGINT AS code FROM events")
def encode_ordinal(t):
    out = _encoded(t, "ordinal", ordinal_mapping={"event_type": ["view", "click", "signup", "purchase"]}, handle_unknown="use_encoded_value")
    return out.select("event_id", big("event_type").alias("code"))


@query("encode_binary", f"SELECT event_id, CAST(code & 1 AS BIGINT) AS b0, CAST((code >> 1) & 1 AS BIGINT) AS b1, CAST((code >> 2) & 1 AS BIGINT) AS b2 FROM events JOIN {_CODES} c USING (event_type)")
def encode_binary(t):
    return _encoded(t, "binary").select("event_id", *[big(f"event_type_bin_{i}").alias(f"b{i}") for i in range(3)])


@query("encode_frequency", f"SELECT event_id, round(n / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events JOIN {_CODES} c USING (event_type)")
def encode_frequency(t):
    return _encoded(t, "frequency").select("event_id", r6("event_type").alias("share"))


@query("encode_target", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 6) AS mean FROM events")
def encode_target(t):
    return _encoded(t, "target", target="value").select("event_id", r6("event_type").alias("mean"))


@query("encode_unknown", f"SELECT event_id, CASE WHEN code < 2 THEN code ELSE -1 END::BIGINT AS code FROM events JOIN {_CODES} c USING (event_type)")
def encode_unknown(t):
    return _encoded(t, "label", max_categories=2, handle_unknown="use_encoded_value").select("event_id", big("event_type").alias("code"))


@query("encode_max_categories", "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) - 1 AS code FROM part GROUP BY p_brand) SELECT p_partkey, CASE WHEN code < 10 THEN code END::BIGINT AS code, code < 10 AS is_valid FROM part JOIN c USING (p_brand)")
def encode_max_categories(t):
    p = t("part").select("p_partkey", "p_brand")
    out = encode.Encoder(["p_brand"], "label", max_categories=10).fit(p, "p_partkey").transform(p)
    return out.select("p_partkey", big("p_brand").alias("code"), F.col(audit.VALID).alias("is_valid"))


def _scaled(t, table, keys, f, strategy, **options):
    df = t(table).select(*keys, f)
    return normalize.Normalizer([f], strategy, **options).fit(df).transform(df).select(*keys, r6(f).alias("v"))


_Q = "(SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem)"


@query("normalize_min_max", f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS v FROM lineitem, {_Q} q")
def normalize_min_max(t):
    return _scaled(t, "lineitem", ["l_orderkey", "l_linenumber"], "l_extendedprice", "min_max")


@query("normalize_min_max_clip", f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo) * 2 - 1, 6) AS v FROM lineitem, {_Q} q")
def normalize_min_max_clip(t):
    return _scaled(t, "lineitem", ["l_orderkey", "l_linenumber"], "l_extendedprice", "min_max", feature_range=(-1.0, 1.0), clip=True)


@query("normalize_z_score", f"SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / sd, 6) AS v FROM lineitem, {_Q} q")
def normalize_z_score(t):
    return _scaled(t, "lineitem", ["l_orderkey", "l_linenumber"], "l_extendedprice", "z_score")


@query("normalize_robust", "WITH s AS (SELECT list_sort(list(c_acctbal)) AS a, count(*) AS n, median(c_acctbal) AS m FROM customer) SELECT c_custkey, round((c_acctbal - m) / greatest(a[(3 * n) // 4 + 1] - a[n // 4 + 1], 1e-8), 6) AS v FROM customer, s")
def normalize_robust(t):
    return _scaled(t, "customer", ["c_custkey"], "c_acctbal", "robust")


@query("normalize_max_abs", "SELECT c_custkey, round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) AS v FROM customer")
def normalize_max_abs(t):
    return _scaled(t, "customer", ["c_custkey"], "c_acctbal", "max_abs")


@query("normalize_unit_vector", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n)))), 6) AS norm, round(embedding[1]::DOUBLE / n, 6) AS v0 FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def normalize_unit_vector(t):
    u = t("embeddings").select("vec_id", normalize.unit_arrays(F.col("embedding")).alias("u"))
    return u.select("vec_id", r6(F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"), r6(F.get("u", F.lit(0))).alias("v0"))


@query("normalize_unit_rows", "SELECT l_orderkey, l_linenumber, round(l_quantity / n, 6) AS q, round(l_tax / n, 6) AS x FROM (SELECT *, sqrt(l_quantity * l_quantity + l_tax * l_tax) AS n FROM lineitem)")
def normalize_unit_rows(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = normalize.Normalizer(["l_quantity", "l_tax"], "unit_vector").fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", r6("l_quantity").alias("q"), r6("l_tax").alias("x"))


@query("normalize_log", "WITH s AS (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END AS k FROM customer) SELECT c_custkey, round(CASE WHEN c_acctbal + k > 0 THEN ln(c_acctbal + k) ELSE 0 END, 6) AS v FROM customer, s")
def normalize_log(t):
    return _scaled(t, "customer", ["c_custkey"], "c_acctbal", "log")


_ON = "(SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS rn, avg(value) OVER (ORDER BY event_id) AS m, stddev_pop(value) OVER (ORDER BY event_id) AS sd FROM events)"


@query("normalize_online_z", f"SELECT a.event_id, round(coalesce((a.value - b.m) / greatest(b.sd, 1e-8), a.value), 5) AS z FROM {_ON} a LEFT JOIN {_ON} b ON b.rn = (a.rn // 1000) * 1000 AND b.rn > 0")
def normalize_online_z(t):
    out = normalize.online_z(t("events").select("event_id", "value"), "value", "event_id")
    return out.select("event_id", F.round("value_z", 5).alias("z"))


@query("normalize_auto_fields", "SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS field")
def normalize_auto_fields(t):
    df = t("lineitem").drop("l_shipdate")
    names = normalize.auto_fields(df)
    return df.sparkSession.createDataFrame([(n,) for n in names], "field string")


@query("is_missing", "SELECT event_id, event_id % 7 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 AS missing FROM events")
def is_missing(t):
    s = F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 17 = 0 THEN 'NaN' ELSE '0' END")
    return t("events").select("event_id", K.is_missing(s).alias("missing"))
