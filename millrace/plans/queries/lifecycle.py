"""What changes while it runs: sources read as text, rules and schemas swapped between batches, groups, streams stopped, reset and reconfigured."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import audit, clean, envelope, features, normalize, schema
from millrace.plans.queries.base import ORACLES, QUERIES, events, query, r6
from millrace.session import shared_dir
from millrace.sources import files, store, topics
from millrace.streaming import query as stream


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


@_query("csv_scan", "SELECT event_id::VARCHAR AS event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'a, \"' || event_type || '\"' END AS note, 4 AS n_columns FROM events")
def csv_scan(spark, d):
    """Every value is text, the header names the columns, quoted separators and quotes are read back."""
    at = _folder(spark, "csv-scan")
    note = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('a, "'), F.col("event_type"), F.lit('"')))
    _events(spark, d).select("event_id", "event_type", note.alias("note"), "value").write.option("header", True).option("escape", '"').csv(at)
    df = files.csv(spark, at, escape='"')
    return df.select("event_id", "event_type", "note", F.lit(len(df.columns)).alias("n_columns"))


@_query("csv_stream_in_batches", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def csv_stream_in_batches(spark, d):
    """A folder of CSV files as a stream, two files a batch."""
    at = _folder(spark, "csv-stream")
    _events(spark, d).select("event_id", "event_type", "value").repartition(6).write.option("header", True).csv(f"{at}/in")
    stream.append(files.csv_stream(spark, f"{at}/in", files_per_batch=2), f"{at}/out", f"{at}/checkpoint").wait()
    rows = spark.read.parquet(f"{at}/out").withColumn("value", F.col("value").cast("double"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query("json_scan", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def json_scan(spark, d):
    at = _folder(spark, "json-scan")
    _events(spark, d).select("event_id", "event_type", "value").write.json(at)
    df = files.read(spark, {"type": "json", "path": at, "schema": "event_id long, event_type string, value double"})
    return df.select("event_id", "event_type", r6("value").alias("value"))


@_query("config_lookup_and_delete", "SELECT event_type AS service_name, 2 AS version, count(*) AS rows FROM events WHERE event_type <> 'click' GROUP BY event_type")
def config_lookup_and_delete(spark, d):
    """A configuration for each event type, written twice; one is deleted, the others are looked up."""
    config = store.ConfigStore(spark, _folder(spark, "config"))
    counts = {r.event_type: r.n for r in _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few types
    config.seed({k: {"rows": 0} for k in counts})
    for k, n in counts.items():
        config.upsert(k, {"rows": n}, expected=1)
    config.delete("click")
    found = [(k, c["version"], c["config"]["rows"]) for k in sorted(counts) if (c := config.get(k)) is not None]
    return spark.createDataFrame(found, "service_name string, version int, rows long")


def _broker(spark: SparkSession, d: str, name: str) -> tuple[topics.Broker, str]:
    b = topics.Broker(spark, _folder(spark, name))
    rows = _events(spark, d).select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    b.publish(rows, "ex", "all", partitions=4, order="event_id")
    return b, b.topic_for("ex", "all")


@_query("groups_consume", "SELECT 'dead' AS kind, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL UNION ALL SELECT 'requeued', 'signup', count(*) FROM events WHERE event_type = 'signup'")
def groups_consume(spark, d):
    """A group rejects errors and puts sign-ups back once: the first go to dead letters, the others come again with the next batch."""
    b, topic = _broker(spark, d, "groups")
    again = _folder(spark, "groups-again")

    def handle(rows: DataFrame) -> DataFrame:
        kind = F.get_json_object("value", "$.event_type")
        early = not marks
        if not early:
            rows.where(kind == "signup").select(kind.alias("event_type")).write.mode("append").parquet(again)
        verdict = F.when(kind == "error", "nack").when((kind == "signup") & F.lit(early), "requeue").otherwise("ack")
        out = rows.select("partition", "offset", verdict.alias("verdict"), F.lit("an error").alias("reason"))
        marks.append(1)
        return out

    marks: list[int] = []
    b.consume(topic, "g", handle).wait()
    b.publish(spark.createDataFrame([('{"event_type": "more"}',)], "value string"), "ex", "all")
    b.consume(topic, "g", handle).wait()
    dead = b.dead(topic).select(F.lit("dead").alias("kind"), F.get_json_object("value", "$.event_type").alias("event_type"))
    back = spark.read.schema("event_type string").parquet(again).select(F.lit("requeued").alias("kind"), "event_type")
    return dead.unionByName(back).groupBy("kind", "event_type").agg(F.count(F.lit(1)).alias("n"))


@_query("unsubscribed_group_begins_anew", "SELECT 'before' AS at, count(*) AS left_over FROM events WHERE event_id >= 0 HAVING false UNION ALL SELECT 'after', count(*) FROM events")
def unsubscribed_group_begins_anew(spark, d):
    b, topic = _broker(spark, d, "unsubscribe")
    n = _events(spark, d).count()
    b.ack(b.fetch(topic, "g", n), "g")
    left = b.fetch(topic, "g", n).count()
    b.unsubscribe(topic, "g")
    rows = ([("before", left)] if left else []) + [("after", b.fetch(topic, "g", n).count())]
    return spark.createDataFrame(rows, "at string, left_over long")


@_query("topics_and_publish_counts", "SELECT 'ex__' || event_type AS topic, count(*) FILTER (WHERE event_id % 10 <> 0) AS published, count(*) FILTER (WHERE event_id % 10 = 0) AS failed FROM events GROUP BY event_type")
def topics_and_publish_counts(spark, d):
    """Every tenth message is no JSON object and fails; what was published is also what the topic list and the stored records show."""
    b = topics.Broker(spark, _folder(spark, "publish"))
    e = _events(spark, d).select("event_type", "event_id", F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.to_json(F.struct("event_id"))).alias("value"))
    told = {}
    for r in e.select("event_type").distinct().collect():  # a few types
        told[b.topic_for("ex", r.event_type)] = b.publish_batch(e.where(F.col("event_type") == r.event_type), "ex", r.event_type)
    rows = spark.createDataFrame([(k, *v) for k, v in told.items()], "topic string, published long, failed long")
    stored = b.stats().select("topic", F.col("messages").alias("stored"))
    return rows.join(b.topics(), "topic").join(stored, "topic").where("stored = published").select("topic", "published", "failed")


@query("normalize_none_and_unfitted", "SELECT event_id, value AS kept, value AS unfitted FROM events")
def normalize_none_and_unfitted(t):
    df = t("events").select("event_id", F.col("value").alias("kept"), F.col("value").alias("unfitted"))
    none = normalize.Normalizer(["kept"], "none").fit(df).transform(df)
    unfitted = normalize.NormalizerModel(normalize.Normalizer(["unfitted"], "z_score"), ["unfitted"], {})
    return unfitted.transform(none).select("event_id", "kept", "unfitted")


@query("feature_columns_by_default", "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(length(event_type) AS INT) AS n FROM events")
def feature_columns_by_default(t):
    """Without a column of its own a date feature takes the first timestamp, a text feature the first text."""
    df = events(t).select("event_id", "value", "ts", "event_type")
    out = features.build(df, [features.Feature("h", "datetime", "hour"), features.Feature("n", "text", "length")])
    return out.select("event_id", "h", "n")


@query("rules_and_features_changed", "SELECT event_id, round(value * 3, 6) AS w, value <= 300 AS ok FROM events")
def rules_and_features_changed(t):
    """A rule and a feature are replaced, others removed, before the batch."""
    cleaner = clean.Cleaner()
    cleaner.add(clean.Rule("value", "reject", max_value=10.0))
    cleaner.add(clean.Rule("value", "reject", max_value=300.0))
    cleaner.add(clean.Rule("event_type", forbidden_values=["click"]))
    cleaner.remove("event_type")
    builder = features.Builder()
    builder.add(features.Feature("w", "arithmetic", "value * 2"))
    builder.add(features.Feature("w", "arithmetic", "value * 3"))
    builder.add(features.Feature("gone", "arithmetic", "value * 4"))
    builder.remove("gone")
    out = cleaner.apply(builder.apply(t("events").select("event_id", "event_type", "value")))
    return out.drop("event_type", "value").select("event_id", r6("w").alias("w"), F.col(audit.VALID).alias("ok"))


@query("schema_swapped", "SELECT event_id, value::VARCHAR IS NOT NULL AS old_ok, event_id % 2 = 0 AS new_ok FROM events")
def schema_swapped(t):
    """The second batch is tested by another schema."""
    df = t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, "7").otherwise("seven").alias("x"))
    v = schema.Validator(schema.fields_of(None, {"event_id": "int", "x": "str"}, ["x"]))
    old = v.apply(df).select("event_id", F.col(audit.VALID).alias("old_ok"))
    v.swap(None, {"event_id": "int", "x": "int"}, ["x"])
    return old.join(v.apply(df).select("event_id", F.col(audit.VALID).alias("new_ok")), "event_id")


@query("envelopes_have_ids_and_times", "SELECT count(*) AS n, count(*) AS ids, true AS timed FROM events")
def envelopes_have_ids_and_times(t):
    m = envelope.envelope(t("events").select("event_id", "value"), "events")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stream_id").alias("ids"), (F.count_if(F.col("timestamp") <= F.current_timestamp()) == F.count(F.lit(1))).alias("timed"))


@_query("stream_stopped_reset_reconfigured", "SELECT 'first' AS run, count(*) AS rows, count(*) FILTER (WHERE value >= 10) AS published FROM events UNION ALL SELECT 'resumed', 0, 0 UNION ALL SELECT 'reconfigured', count(*) FILTER (WHERE event_id % 4 = 0), count(*) FILTER (WHERE event_id % 4 = 0 AND value >= 50) FROM events UNION ALL SELECT 'reset', count(*) + count(*) FILTER (WHERE event_id % 4 = 0), count(*) FILTER (WHERE value >= 10) + count(*) FILTER (WHERE value >= 10 AND event_id % 4 = 0) FROM events")
def stream_stopped_reset_reconfigured(spark, d):
    """A stream goes on where it stopped, takes new rules for new rows, and after a reset reads everything again; its status tells rows and successes."""
    at = _folder(spark, "stream-life")
    e = _events(spark, d).select("event_id", "value")
    e.write.parquet(f"{at}/in")

    def start(least: float, out: str):
        rows = clean.clean(spark.readStream.schema(e.schema).parquet(f"{at}/in"), [clean.Rule("value", "reject", least)])
        return lambda checkpoint: stream.start(rows, f"{at}/{out}", checkpoint, f"{at}/{out}-rejected")

    told, checkpoint = [], f"{at}/checkpoint"
    run = start(10.0, "a")(checkpoint)
    told.append(("first", run.wait()))
    run.stop()
    run = start(10.0, "a")(checkpoint)
    told.append(("resumed", run.wait()))
    e.where("event_id % 4 = 0").write.mode("append").parquet(f"{at}/in")
    run = run.reconfigured(start(50.0, "b"))
    told.append(("reconfigured", run.wait()))
    run.reset()
    told.append(("reset", start(10.0, "c")(checkpoint).wait()))
    return spark.createDataFrame([(k, s["rows"], s["published"]) for k, s in told], "run string, rows long, published long")
