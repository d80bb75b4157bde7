"""Streams whose rows come late and out of order: in order through state, late ones to a side output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.queries.base import ORACLES, QUERIES, big, r6
from millrace.session import shared_dir
from millrace.streaming import query as stream
from millrace.streaming import seen, timed


_PERIOD = 6 * 86400


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _delivered(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str, str, str]:
    """``events`` in files by periods of their time, every third row a period late, and folders for what a stream of them makes."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e = e.withColumn("part", F.floor(F.unix_seconds("ts") / _PERIOD) + (F.col("event_id") % 3 == 0).cast("int"))
    for p in sorted(r.part for r in e.select("part").distinct().collect()):  # as many as periods
        e.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(f"{out}/in")
    rows = spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    return rows, f"{out}/good", f"{out}/late", f"{out}/checkpoint"


_PUNCTUAL = f"""
d AS (SELECT event_id, event_type, ts, value, epoch_ms(ts) AS ms, CAST(floor(epoch(ts) / {_PERIOD}) AS BIGINT) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS part FROM events),
w AS (SELECT part, coalesce(max(max(ms)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {5 * 86_400_000} AS passed FROM d GROUP BY part),
a AS (SELECT *, ms < passed AS late FROM d JOIN w USING (part)),
p AS (SELECT * FROM a WHERE NOT late AND ms < (SELECT max(ms) FROM d) - {5 * 86_400_000})"""


@_query("stream_in_order", f"""WITH {_PUNCTUAL},
r AS (SELECT event_id, event_type, ms, count(value) OVER w AS a_count, round(sum(value) OVER w, 4) AS a_sum, min(value) OVER w AS a_min, last_value(value) OVER w AS a_last, round(median(value) OVER w, 6) AS a_median,
 list_sort(list(value) OVER w) AS l, list(value) OVER w AS s FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, a_count, a_sum, a_min, a_last, a_median, round(l[CAST(least(floor(a_count * 0.9::DOUBLE), a_count - 1) AS INT) + 1], 6) AS a_p90, CAST(len(list_distinct(s)) AS BIGINT) AS a_unique FROM r""")
def stream_in_order(spark, d):
    """A stream of late and shuffled deliveries gives what the batch over the punctual rows gives."""
    rows, good, late, checkpoint = _delivered(spark, d, "stream-in-order")
    functions = ["count", "sum", "min", "last", "median", "p90", "unique"]
    out = timed.in_order(rows, ["event_type"], "value", "ts", "event_id", "a", functions, "5 days")
    stream.start(out, good, checkpoint, late).wait()
    return spark.read.parquet(good).select("event_id", "a_count", F.round("a_sum", 4).alias("a_sum"), "a_min", "a_last", r6("a_median").alias("a_median"), r6("a_p90").alias("a_p90"), "a_unique")


@_query("stream_late_rows", f"WITH {_PUNCTUAL} SELECT event_id, value, 'late' AS error FROM a WHERE late")
def stream_late_rows(spark, d):
    rows, good, late, checkpoint = _delivered(spark, d, "stream-late")
    stream.start(timed.in_order(rows, ["event_type"], "value", "ts", "event_id", "a", ["count"], "5 days"), good, checkpoint, late).wait()
    return spark.read.parquet(late).select("event_id", "value", F.col("_errors")[0]["error"].alias("error"))


@_query("stream_windows_with_late", f"""WITH {_PUNCTUAL}, k AS (SELECT *, ms // 86400000 * 86400000 AS s FROM a)
SELECT 'window' AS kind, event_type, s AS start, count(value) AS n, round(sum(value), 4) AS total FROM k WHERE s + 86400000 > passed AND s + 86400000 <= (SELECT max(ms) FROM d) - {5 * 86_400_000} GROUP BY ALL
UNION ALL SELECT 'late', event_type, NULL, count(*), round(sum(value), 4) FROM k WHERE s + 86400000 <= passed GROUP BY ALL""")
def stream_windows_with_late(spark, d):
    rows, good, late, checkpoint = _delivered(spark, d, "stream-windows")
    stream.start(timed.at_close(rows, ["event_type"], "value", "ts", "event_id", "1 day", "w", ["count", "sum"], "5 days"), good, checkpoint, late).wait()
    closed = spark.read.parquet(good).select(F.lit("window").alias("kind"), "event_type", F.unix_millis("window_start").alias("start"), big("w_count").alias("n"), F.round("w_sum", 4).alias("total"))
    behind = spark.read.parquet(late).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return closed.unionByName(behind.select(F.lit("late").alias("kind"), "event_type", F.lit(None).cast("long").alias("start"), "n", "total"))


@_query("stream_seen_keys", "SELECT event_id, value, 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS copies FROM events")
def stream_seen_keys(spark, d):
    """Every third event comes a second time, in another file: it is marked, in memory of a few bits a key."""
    out = f"{shared_dir(spark)}/stream-seen-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    e.write.parquet(f"{out}/in")
    e.where("event_id % 3 = 0").write.mode("append").parquet(f"{out}/in")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    # more keys than the table has would be forgotten and count as new again; a bucket's share differs by chance
    kept = seen.marked(rows, ["event_id"], "event_id", capacity=max(10_000_000, 2 * e.count()), buckets=8)
    stream.append(kept, f"{out}/good", f"{out}/checkpoint").wait()
    got = spark.read.parquet(f"{out}/good")
    copies = got.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))
    return got.where("NOT _is_duplicate").join(copies, "event_id").select("event_id", "value", "copies")
