"""Kafka as sink and source, by Spark's connector (which must be on the class path).

Records are written with acks of all replicas, idempotently and with retries; topics are made by the broker
at the first record where it allows that. A group's offsets are those of the stream's checkpoint, or, for batches,
of the caller.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.streaming.query import trigger

# What a producer is asked for.
PRODUCER = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.retries": "5", "kafka.retry.backoff.ms": "200", "kafka.delivery.timeout.ms": "30000"}


@dataclass(frozen=True)
class Kafka:
    servers: str
    options: dict[str, str] = field(default_factory=dict)

    def producer(self) -> dict[str, str]:
        return PRODUCER | {"kafka.bootstrap.servers": self.servers} | self.options

    def consumer(self, topics: list[str], starting: str | dict = "earliest", most: int | None = None) -> dict[str, str]:
        """Options of a read: ``starting`` may be offsets {topic: {partition: offset}}; ``most`` bounds a batch of a stream."""
        start = starting if isinstance(starting, str) else json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in starting.items()})
        bound = {} if most is None else {"maxOffsetsPerTrigger": str(most)}
        return {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(topics), "startingOffsets": start, "failOnDataLoss": "true"} | bound | self.options

    @staticmethod
    def messages(df: DataFrame, topic: Column, key: Column | None = None, value: Column | None = None) -> DataFrame:
        """key, value (JSON of all columns by default) and topic: what the connector writes."""
        value = F.to_json(F.struct(*df.columns)) if value is None else value
        return df.select((F.lit(None).cast("string") if key is None else key.cast("string")).alias("key"), value.alias("value"), topic.alias("topic"))

    @staticmethod
    def records(df: DataFrame) -> DataFrame:
        """topic, partition, offset, value, published_at: the shape of the broker's own records."""
        return df.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("published_at"))

    def publish(self, messages: DataFrame) -> None:
        messages.write.format("kafka").options(**self.producer()).save()

    def publish_stream(self, messages: DataFrame, checkpoint: str, interval: float | None = None) -> StreamingQuery:
        return messages.writeStream.format("kafka").options(**self.producer()).option("checkpointLocation", checkpoint).trigger(**trigger(interval)).start()

    def peek(self, spark: SparkSession, topic: str, most: int = 10) -> DataFrame:
        """The first records, without a group."""
        return self.records(spark.read.format("kafka").options(**self.consumer([topic])).load()).orderBy("partition", "offset").limit(most)

    def stream(self, spark: SparkSession, topics: list[str], starting: str | dict = "earliest", most: int | None = None) -> DataFrame:
        return self.records(spark.readStream.format("kafka").options(**self.consumer(topics, starting, most)).load())
