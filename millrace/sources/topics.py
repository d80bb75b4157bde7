"""Topics as folders of Parquet files: append-only logs with partitions and offsets.

A record has topic, partition, offset, value (JSON) and published_at. Groups keep their own
committed offsets, or, as streams (``consume``), their own checkpoints; rejected records go to the topic's dead-letter topic with the
reason. A topic has one writer at a time, as a folder of files has no lock. ``millrace.sources.kafka`` writes to and reads from Kafka itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import drop_written, written
from millrace.streaming.query import Counts, Running, trigger

RECORD = "topic string, partition int, offset bigint, value string, published_at timestamp"
COMMIT = "topic string, group_id string, partition int, next_offset bigint, epoch bigint, committed_at timestamp"
HIDDEN = "__consumer_offsets"


class Broker:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, folder: str, schema: str) -> DataFrame:
        """An empty frame where nothing has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if there else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self._read("records", RECORD)

    @staticmethod
    def topic_for(exchange: str, routing_key: str) -> str:
        return f"{exchange}__{routing_key}".lower().replace("-", "_")

    def _append(self, rows: DataFrame) -> int:
        """Append (topic, partition, value, _o); returns how many. Offsets go on from the last in the order of _o.

        Rows are dealt by range of (topic, partition, _o) and stored; each range's count is carried to the later ones, so a
        topic with one partition needs no single task.
        """
        key = ["topic", "partition"]
        stored = written(rows.select(*key, "value", "_o").repartitionByRange(*key, "_o").withColumn("_part", F.spark_partition_id()), "topic-rows")
        counts = stored.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
        last = self.records().groupBy(*key).agg((F.max("offset") + 1).alias("_next"))
        carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(last, key, "left").select(*key, "_part", (F.coalesce("_next", F.lit(0)) + F.col("_before")).alias("_first"))
        own = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_o")) - 1
        out = stored.withColumn("_i", own).join(carried, [*key, "_part"])
        out = out.select("topic", "partition", (F.col("_first") + F.col("_i")).cast("bigint").alias("offset"), "value", F.current_timestamp().alias("published_at"))
        out.write.mode("append").partitionBy("topic").parquet(f"{self.root}/records")
        n = counts.agg(F.sum("_n")).first()[0] or 0
        drop_written(stored)
        return n

    def publish(self, messages: DataFrame, exchange: str, routing_key: str, partitions: int = 1, order: str | None = None) -> int:
        """Append (value) rows; returns how many. A partition's order is that of ``order``."""
        key = F.col(order) if order else F.monotonically_increasing_id()
        part = F.pmod(F.xxhash64("value"), F.lit(partitions)).cast("int")
        return self._append(messages.select(F.lit(self.topic_for(exchange, routing_key)).alias("topic"), part.alias("partition"), "value", key.alias("_o")))

    def publish_batch(self, messages: DataFrame, exchange: str, routing_key: str, partitions: int = 1, order: str | None = None) -> tuple[int, int]:
        """(published, failed): rows whose value is no JSON object fail and are left out."""
        fine = F.coalesce(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.lit(False))
        failed = messages.where(~fine).count()
        return self.publish(messages.where(fine), exchange, routing_key, partitions, order), failed

    def peek(self, topic: str, most: int = 10) -> DataFrame:
        """The first records, without committing; with _meta."""
        r = self.records().where(F.col("topic") == topic).orderBy("partition", "offset").limit(most)
        return r.select("value", F.struct("topic", "partition", "offset").alias("_meta"))

    def epoch(self, topic: str, group: str) -> int:
        """How often the group has left the topic: commits of earlier times count no more."""
        c = self._read("commits", COMMIT).where((F.col("topic") == topic) & (F.col("group_id") == group))
        return c.agg(F.max("epoch")).first()[0] or 0

    def committed(self, topic: str, group: str) -> DataFrame:
        c = self._read("commits", COMMIT).where((F.col("topic") == topic) & (F.col("group_id") == group))
        last = c.groupBy("partition", F.coalesce("epoch", F.lit(0)).alias("epoch")).agg(F.max("next_offset").alias("next_offset"))
        return last.groupBy("partition").agg(F.max_by("next_offset", "epoch").alias("next_offset")).where("next_offset > 0")

    def fetch(self, topic: str, group: str, most: int = 10) -> DataFrame:
        """The group's next records, with _delivery; nothing is committed until ``ack``."""
        r = self.records().where(F.col("topic") == topic).join(F.broadcast(self.committed(topic, group)), "partition", "left")
        r = r.where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).orderBy("partition", "offset").limit(most)
        tag = F.concat_ws(":", "topic", "partition", "offset")
        return r.select("value", F.struct(tag.alias("delivery_tag"), "topic", "partition", "offset", F.lit(topic).alias("queue"), F.lit(group).alias("group_id")).alias("_delivery"))

    def ack(self, deliveries: DataFrame, group: str) -> None:
        """Commit up to the last of these deliveries in each partition."""
        done = deliveries.select("_delivery.*").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
        now = self._read("commits", COMMIT).where(F.col("group_id") == group).groupBy("topic").agg(F.max("epoch").alias("epoch"))
        done = done.join(F.broadcast(now), "topic", "left")
        self._commit(done.select("topic", F.lit(group).alias("group_id"), "partition", "next_offset", F.coalesce("epoch", F.lit(0)).cast("bigint").alias("epoch")))

    def _commit(self, rows: DataFrame) -> None:
        stored = written(rows, "topic-commits")  # what is read is the folder that is written to
        stored.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/commits")
        drop_written(stored)

    def nack(self, deliveries: DataFrame, group: str, requeue: bool = False, reason: str = "") -> None:
        """Without requeue: copy to the dead-letter topic and commit past. With it: leave uncommitted, so it comes again.

        A dead letter has the payload's own fields and _dead_letter; a payload that is no object is kept as ``payload``.
        """
        if requeue:
            return
        d = deliveries.select("value", "_delivery.*")
        self._append(d.select(F.concat("topic", F.lit("__dlq")).alias("topic"), F.lit(0).alias("partition"), letter(F.lit(reason or "rejected")).alias("value"), F.struct("topic", "partition", "offset").alias("_o")))
        self.ack(deliveries, group)

    def unsubscribe(self, topic: str, group: str) -> None:
        """Forget a group's offsets: its next fetch begins at the first record."""
        done = self.committed(topic, group).select(F.lit(topic).alias("topic"), F.lit(group).alias("group_id"), "partition", F.lit(0).cast("bigint").alias("next_offset"), F.lit(self.epoch(topic, group) + 1).cast("bigint").alias("epoch"))
        self._commit(done)

    def consume(self, topic: str, group: str, handle: Callable[[DataFrame], DataFrame], prefetch: int | None = None, interval: float | None = None, name: str | None = None) -> Running:
        """A group's own stream over a topic: ``handle`` takes (topic, partition, offset, value) and returns (partition, offset, verdict, reason).

        Verdicts: ack; nack (to the dead-letter topic); requeue (comes again with the next batch). A record without a verdict is acknowledged.
        The group's place is its checkpoint, so groups go at their own pace and a restart delivers again only the batch
        that had not ended. ``prefetch`` bounds the files of a batch. Dead letters and requeued records of a batch are
        written under its number and replaced if it runs again; the topic ``<topic>__dlq`` shows all groups' dead letters.
        """
        at = f"{self.root}/groups/{group}/{topic}"
        schema = "partition int, offset bigint, value string, published_at timestamp"
        reader = self.spark.readStream.schema(schema)
        rows = (reader.option("maxFilesPerTrigger", prefetch) if prefetch else reader).parquet(f"{self.root}/records/topic={topic}")
        counts = Counts()

        def batch(new: DataFrame, number: int) -> None:
            fields = ["partition", "offset", "value"]
            again = self._read(f"groups/{group}/{topic}/requeued/batch={number - 1}", "partition int, offset bigint, value string")
            got = written(new.select(*fields).unionByName(again.select(*fields)), "topic-batch")
            told = handle(got.withColumn("topic", F.lit(topic)))
            told = written(told.select("partition", "offset", "verdict", F.coalesce("reason", F.lit("rejected")).alias("reason")), "topic-verdicts")
            got_told = got.join(told, ["partition", "offset"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("ack")))
            dead = got_told.where("verdict = 'nack'").withColumn("topic", F.lit(topic))
            dead.select("topic", "partition", "offset", letter(F.col("reason")).alias("value")).write.mode("overwrite").parquet(f"{at}/dead/batch={number}")
            got_told.where("verdict = 'requeue'").select(*fields).write.mode("overwrite").parquet(f"{at}/requeued/batch={number}")
            n = got_told.agg(F.count_if(F.col("verdict") == "ack"), F.count_if(F.col("verdict") != "ack")).first()
            counts.add(number, *n)
            for done in (told, got):
                drop_written(done)

        writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/checkpoint").trigger(**trigger(interval))
        return Running((writer.queryName(name) if name else writer).start(), f"{at}/checkpoint", counts)

    def dead(self, topic: str) -> DataFrame:
        """group_id, value: dead letters of the groups that ``consume`` a topic."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/groups/*/{topic}/dead/batch=*/*.parquet")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            return self.spark.createDataFrame([], "group_id string, value string")
        rows = self.spark.read.schema("value string").parquet(f"{self.root}/groups/*/{topic}/dead/batch=*")
        return rows.select(F.regexp_extract(F.input_file_name(), r"/groups/([^/]+)/", 1).alias("group_id"), "value")

    def backlog(self) -> DataFrame:
        return backlog(self.records())

    def bindings(self, exchange: str) -> DataFrame:
        return bindings(self.records().select("topic"), exchange)

    def stats(self) -> DataFrame:
        return stats(self.records())

    def topics(self) -> DataFrame:
        return self.records().select("topic").distinct().where(F.col("topic") != HIDDEN).orderBy("topic")


def letter(reason: Column) -> Column:
    """Of a record (topic, partition, offset, value): its payload's own fields and _dead_letter; a payload that is no object is kept as ``payload``."""
    told = F.struct(F.col("topic").alias("source_topic"), "partition", "offset", reason.alias("reason"), F.current_timestamp().alias("failed_at"))
    note = F.concat(F.lit('"_dead_letter":'), F.to_json(told), F.lit("}"))
    bare = F.regexp_replace(F.rtrim("value"), r"\s*\}$", "")
    merged = F.when(bare.rlike(r"^\s*\{\s*$"), F.concat(bare, note)).otherwise(F.concat(bare, F.lit(","), note))
    kept = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("value").alias("payload"))), r"\}$", ","), note)
    return F.when(F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$"), merged).otherwise(F.when(F.col("value").isNull(), F.concat(F.lit("{"), note)).otherwise(kept))


def backlog(records: DataFrame) -> DataFrame:
    """topic, depth: the sum over partitions of (last offset - first offset + 1)."""
    per = records.groupBy("topic", "partition").agg((F.max("offset") - F.min("offset") + 1).alias("n"))
    return per.groupBy("topic").agg(F.sum("n").alias("depth"))


def bindings(topics: DataFrame, exchange: str) -> DataFrame:
    """routing_key: what follows the exchange in its topics' names, sorted."""
    prefix = Broker.topic_for(exchange, "")
    return topics.where(F.col("topic").startswith(prefix)).select(F.substr("topic", F.lit(len(prefix) + 1)).alias("routing_key")).distinct().orderBy("routing_key")


def stats(records: DataFrame) -> DataFrame:
    """topic, messages, partitions, first_at, last_at, per_second: of each topic, dead letters as topics of their own."""
    per = records.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("partition").alias("partitions"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))
    span = F.unix_micros("last_at") - F.unix_micros("first_at")
    return per.withColumn("per_second", F.when(span > 0, F.col("messages") * 1e6 / span).otherwise(F.col("messages").cast("double")))
