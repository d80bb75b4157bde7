"""Envelope, topics, stored documents, metrics, streams, and the whole pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import audit, clean, convert, envelope, learning
from millrace.operators import windows as W
from millrace.plans.pipeline import Pipeline
from millrace.plans.queries.base import QUERIES, ORACLES, big, events, query, r6
from millrace.session import shared_dir
from millrace.sources import store, topics
from millrace.streaming import query as stream
from millrace.streaming import stateful


@query("envelope_build", "SELECT concat('s-', CAST(event_id % 3 AS VARCHAR)) AS stream_id, 'csv' AS source, 'data_point' AS event_type, event_id AS d_event_id, value AS d_value, event_type AS m_status, 'topic' AS m_topic FROM events")
def envelope_build(t):
    e = t("events").select("event_id", "value", F.col("event_type").alias("status"))
    out = envelope.envelope(e, "csv", F.concat(F.lit("s-"), (F.col("event_id") % 3).cast("string")), extra={"publish_topic": "topic"}, timestamp=F.lit(0).cast("timestamp"))
    return out.select("stream_id", "source", "event_type", F.col("data.event_id").alias("d_event_id"), F.col("data.value").alias("d_value"), F.col("metadata")["status"].alias("m_status"), F.col("metadata")["publish_topic"].alias("m_topic"))


@query("rejected_ledger", "SELECT o_orderkey, 'clean' AS stage, 'o_totalprice' AS field, CASE WHEN o_totalprice < 20000 THEN 'below_minimum' ELSE 'above_maximum' END AS error FROM orders WHERE o_totalprice < 20000 OR o_totalprice > 200000")
def rejected_ledger(t):
    return audit.ledger(clean.clean(t("orders"), [clean.Rule("o_totalprice", "reject", 20000.0, 200000.0)]), "o_orderkey").select("o_orderkey", "stage", "field", "error")


@query("stage_stats", "SELECT count(*) AS total_rows, count(*) FILTER (WHERE o_totalprice >= 20000) AS valid_rows, count(*) FILTER (WHERE NOT o_totalprice >= 20000) AS rejected_rows, round(count(*) FILTER (WHERE o_totalprice >= 20000) / count(*)::DOUBLE, 6) AS success_rate FROM orders")
def stage_stats(t):
    out = audit.stats(clean.clean(t("orders"), [clean.Rule("o_totalprice", "reject", 20000.0)]))
    return out.select("total_rows", "valid_rows", "rejected_rows", r6("success_rate").alias("success_rate"))


@query("topic_routing", "SELECT DISTINCT replace(lower(concat('Stream-Exchange__', event_type)), '-', '_') AS topic, replace(lower(concat('Stream-Exchange__', event_type)), '-', '_') || '__dlq' AS dlq FROM events")
def topic_routing(t):
    name = envelope.topic(F.lit("Stream-Exchange"), F.col("event_type"))
    return t("events").select(name.alias("topic"), envelope.dead_letter_topic(name).alias("dlq")).distinct()


def _records(t):
    return t("events").select(envelope.topic(F.lit("ex"), F.col("event_type")).alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), "value")


_REC = "(SELECT concat('ex__', event_type) AS topic, user_id % 3 AS partition, event_id AS offset_, value FROM events)"


@query("queue_backlog", f"WITH p AS (SELECT topic, partition, max(offset_) - min(offset_) + 1 AS n FROM {_REC} r GROUP BY ALL) SELECT topic, CAST(sum(n) AS BIGINT) AS depth FROM p GROUP BY topic")
def queue_backlog(t):
    return topics.backlog(_records(t)).select("topic", big("depth").alias("depth"))


@query("exchange_bindings", "SELECT DISTINCT event_type AS routing_key FROM events")
def exchange_bindings(t):
    return topics.bindings(_records(t).select("topic"), "ex")


def _broker(spark, name):
    return topics.Broker(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _published(spark, d, name, kind):
    """A broker with the events of one type, in order, in one partition."""
    b = _broker(spark, name)
    rows = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind).select("event_id", F.to_json(F.struct("event_id", "user_id")).alias("value"))
    b.publish(rows, "ex", kind, order="event_id")
    return b, b.topic_for("ex", kind)


def _register(name, sql, f):
    QUERIES[name], ORACLES[name] = f, sql


def peek_limit(spark, d):
    b, topic = _published(spark, d, "peek", "view")
    return b.peek(topic, 10).select(F.col("_meta.topic").alias("topic"), big(F.col("_meta.partition")).alias("partition"), F.col("_meta.offset").alias("offset"), F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


_register("peek_limit", "SELECT 'ex__view' AS topic, 0::BIGINT AS partition, row_number() OVER (ORDER BY event_id) - 1 AS \"offset\", event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 10", peek_limit)


def consume_after_ack(spark, d):
    """Twenty records are acknowledged, the next ten requeued: they come again."""
    b, topic = _published(spark, d, "consume", "click")
    b.ack(b.fetch(topic, "g", 20), "g")
    b.nack(b.fetch(topic, "g", 10), "g", requeue=True)
    out = b.fetch(topic, "g", 10)
    return out.select(F.col("_delivery.delivery_tag").alias("delivery_tag"), F.col("_delivery.offset").alias("offset"), F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))


_register("consume_after_ack", "SELECT concat('ex__click:0:', CAST(n AS VARCHAR)) AS delivery_tag, n AS \"offset\", event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type = 'click') WHERE n BETWEEN 20 AND 29", consume_after_ack)


def dead_letters(spark, d):
    """Fifty records are rejected: their fields go to the dead-letter topic with the reason."""
    b, topic = _published(spark, d, "dead", "error")
    b.nack(b.fetch(topic, "g", 50), "g")
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return b.records().where(F.col("topic") == f"{topic}__dlq").select(
        "offset", at("$.event_id", "bigint").alias("event_id"), at("$.user_id", "bigint").alias("user_id"), at("$._dead_letter.source_topic", "string").alias("source_topic"),
        at("$._dead_letter.offset", "bigint").alias("source_offset"), at("$._dead_letter.reason", "string").alias("reason"),
    )


_register("dead_letters", "SELECT n AS \"offset\", event_id, user_id, 'ex__error' AS source_topic, n AS source_offset, 'rejected' AS reason FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type = 'error') WHERE n < 50", dead_letters)


def broker_totals(spark, d):
    b, topic = _published(spark, d, "totals", "error")
    b.nack(b.fetch(topic, "g", 5), "g")
    return b.stats().select("topic", "messages", "partitions")


_register("broker_totals", "SELECT 'ex__error' AS topic, count(*) AS messages, 1::BIGINT AS partitions FROM events WHERE event_type = 'error' UNION ALL SELECT 'ex__error__dlq', least(5, count(*)), 1 FROM events WHERE event_type = 'error'", broker_totals)


@query("recent_errors", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 10")
def recent_errors(t):
    return store.find(t("events"), {"event_type": "error"}, [F.desc("event_id")], 10).select("event_id", "user_id")


@query("paginate", "SELECT o_orderkey, CAST((SELECT count(*) FROM orders) AS BIGINT) AS total_items, CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def paginate(t):
    rows, info = store.page(t("orders").select("o_orderkey"), 3, 20, "o_orderkey")
    return rows.select("o_orderkey", F.lit(info["total_items"]).cast("bigint").alias("total_items"), F.lit(info["total_pages"]).cast("bigint").alias("total_pages"))


@query("latest_version_upsert", "SELECT user_id, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_version_upsert(t):
    return store.latest(t("events").select("user_id", F.col("event_id").alias("version"), "value"), ["user_id"], "version")


def seed_missing(spark, d):
    """Two services are there in their second version; seeding all event types adds the others."""
    config = store.ConfigStore(spark, f"{shared_dir(spark)}/config-{uuid.uuid4().hex}")
    for name in ("click", "error", "click", "error"):
        config.upsert(name, {"own": True})
    kinds = [r.event_type for r in spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct().collect()]
    config.seed({k: {"own": False} for k in kinds})
    return config.list_all().select("service_name", big("version").alias("version"), (F.get_json_object("config_data", "$.own") == "true").alias("own"))


_register("seed_missing", "SELECT DISTINCT event_type AS service_name, CASE WHEN event_type IN ('click', 'error') THEN 2 ELSE 1 END::BIGINT AS version, event_type IN ('click', 'error') AS own FROM events", seed_missing)


@query("storage_find_paged", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY conv_id, turn LIMIT 50 OFFSET 25")
def storage_find_paged(t):
    return store.find(t("conversations"), {"role": "user"}, ["conv_id", "turn"], 50, 25).select("conv_id", "turn")


def storage_count(spark, d):
    """Conversations are saved, the system's turns deleted, the user's updated, and all counted by role and flag."""
    c = store.Collection(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", "role string, turn bigint, seen boolean")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("_id"), "role", "turn", F.lit(False).alias("seen"))
    c.save(rows)
    c.delete({"turn": 0})
    c.update({"role": "user"}, {"seen": True})
    return c.current().groupBy("role", "seen").agg(F.count(F.lit(1)).alias("n"))


_register("storage_count", "SELECT role, role = 'user' AS seen, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE turn <> 0) GROUP BY ALL", storage_count)


@query("state_retention", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def state_retention(t):
    return store.retained(t("events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("prequential_accuracy", "WITH p AS (SELECT event_id, user_id, CASE WHEN (value > 20) IS NOT DISTINCT FROM (lag(value) OVER (PARTITION BY user_id ORDER BY event_id) > 20) THEN 1.0 ELSE 0.0 END AS ok FROM events) SELECT event_id, round(avg(ok) OVER w, 6) AS accuracy, count(*) OVER w AS sample_count FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def prequential_accuracy(t):
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t("events").withColumns({"actual": F.col("value") > 20, "predicted": before > 20})
    return learning.prequential(rows, "event_id", "actual", "predicted", ["user_id"], 50).select("event_id", r6("accuracy").alias("accuracy"), "sample_count")


def _streamed(spark, d):
    schema_ = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema_).option("pathGlobFilter", "events.parquet").parquet(d)


def _folders(spark, name):
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{at}/out", f"{at}/checkpoint"


def stream_pipeline_stateless(spark, d):
    out, checkpoint = _folders(spark, "stream-stateless")
    rows = _streamed(spark, d).select("event_id", F.col("value").cast("string").alias("v"), "event_type")
    rows = clean.clean(convert.convert(rows, {"v": "float"}), [clean.Rule("v", "reject", 1.0, 100.0), clean.Rule("event_type", forbidden_values=["error"])])
    stream.start(rows, out, checkpoint).wait()
    return spark.read.parquet(out).select("event_id", "v", "event_type")


_register("stream_pipeline_stateless", "SELECT event_id, value AS v, event_type FROM events WHERE value >= 1 AND value <= 100 AND event_type <> 'error'", stream_pipeline_stateless)


def stream_dedup(spark, d):
    out, checkpoint = _folders(spark, "stream-dedup")
    stream.append(stateful.dedup(_streamed(spark, d), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type"), out, checkpoint).wait()
    return spark.read.parquet(out)


_register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events", stream_dedup)


def stream_tumbling_final(spark, d):
    out, checkpoint = _folders(spark, "stream-tumbling")
    w = W.TimeWindow("w", "value", "ts", "tumbling", 3600.0, functions=["count", "sum"], group_by=["event_type"])
    stream.append(stateful.at_close(_streamed(spark, d), w, "1 hour"), out, checkpoint).wait()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "w_count", r6("w_sum").alias("w_sum"))


_register("stream_tumbling_final", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS w_count, round(sum(value), 6) AS w_sum FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL", stream_tumbling_final)


def stream_running_agg(spark, d):
    out, checkpoint = _folders(spark, "stream-running")
    stream.append(stateful.running(_streamed(spark, d), ["user_id"], "value", "event_id", "a"), out, checkpoint).wait()
    return spark.read.parquet(out).select("event_id", "a_count", r6("a_sum").alias("a_sum"), "a_min", "a_max")


_register("stream_running_agg", "SELECT event_id, count(value) OVER w AS a_count, round(sum(value) OVER w, 6) AS a_sum, min(value) OVER w AS a_min, max(value) OVER w AS a_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)", stream_running_agg)

CONFIG = {
    "validation": {
        "schema": {"enabled": True, "fields": [{"name": "event_id", "type": "int"}, {"name": "ts", "type": "datetime"}, {"name": "user_id", "type": "int"}, {"name": "event_type", "type": "str"}, {"name": "value", "type": "float"}]},
        "duplicate": {"enabled": True, "key_fields": ["event_id"], "strategy": "reject"},
    },
    "transformation": {
        "data_cleaning": {"enabled": True, "rules": {"value": {"action": "cap", "min_value": 0.0, "max_value": 400.0}}},
        "encoding": {"enabled": True, "strategy": "label", "categorical_fields": ["event_type"]},
        "normalization": {"enabled": True, "strategy": "min_max", "fields": ["value"]},
    },
    "features": {
        "feature_builder": {"enabled": True, "features": [{"name": "hour", "feature_type": "datetime", "expression": "hour", "column": "ts"}, {"name": "is_weekend", "feature_type": "datetime", "expression": "is_weekend", "column": "ts"}]},
        "window_features": {"enabled": True, "windows": [{"name": "trail", "source_field": "value", "time_field": "ts", "window_type": "sliding", "window_size": "1 hour", "aggregations": ["count", "mean"], "group_by": ["user_id"]}]},
        "aggregation": {"enabled": True, "aggregations": [{"name": "total", "source_field": "value", "group_by": ["event_type"], "functions": ["sum"]}]},
    },
}


_FLAGSHIP = """
WITH c AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) - 1 AS code FROM events GROUP BY event_type),
k AS (SELECT event_id, ts, user_id, code, greatest(least(value, 400.0::DOUBLE), 0.0::DOUBLE) AS v FROM events JOIN c USING (event_type)),
n AS (SELECT *, (v - (SELECT min(v) FROM k)) / ((SELECT max(v) FROM k) - (SELECT min(v) FROM k)) AS x FROM k)
SELECT 'flagship' AS stream_id, 'events' AS source, 'data_point' AS event_type, event_id, user_id, CAST(code AS BIGINT) AS type_code, round(x, 6) AS value, CAST(hour(ts) AS BIGINT) AS hour,
       CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend, count(x) OVER t AS trail_count, round(avg(x) OVER t, 6) AS trail_mean,
       round(sum(x) OVER (PARTITION BY code ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5) AS total_sum
FROM n WINDOW t AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
"""


def _flagship(e):
    p = Pipeline.of(CONFIG, "event_id").fit(e)
    m = envelope.envelope(p.accepted(e), "events", "flagship", metadata=(), timestamp=F.lit(0).cast("timestamp"))
    d = lambda c: F.col(f"data.{c}")
    return m.select(
        "stream_id", "source", "event_type", d("event_id").alias("event_id"), d("user_id").alias("user_id"), big(d("event_type")).alias("type_code"), r6(d("value")).alias("value"), big(d("hour")).alias("hour"),
        big(d("is_weekend")).alias("is_weekend"), big(d("trail_count")).alias("trail_count"), r6(d("trail_mean")).alias("trail_mean"), F.round(d("total_sum"), 5).alias("total_sum"),
    )


@query("full_pipeline", _FLAGSHIP)
def full_pipeline(t):
    return _flagship(events(t).drop("props"))


@query("full_pipeline_delivered_again", _FLAGSHIP)
def full_pipeline_delivered_again(t):
    """Every fourth event comes twice: the pipeline's stage rejects it, and the result is that of ``events``."""
    e = events(t).drop("props")
    return _flagship(e.unionByName(e.where("event_id % 4 = 0")))


@query("drift_records", """
WITH p AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS d, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1),
q AS (SELECT d, coalesce(abs(m - lag(m) OVER (ORDER BY d)) / greatest(lag(s) OVER (ORDER BY d), 1e-8), 0) AS z FROM p)
SELECT strftime(d + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS closed_at, round(z, 6) AS drift_score, z > 0.1 AS is_drift FROM q
""")
def drift_records(t):
    out = learning.drift(events(t), "ts", "value", "1 day", 0.1)
    return out.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("closed_at"), r6("drift_score").alias("drift_score"), "is_drift")
