"""Stream messages: rows in a standard envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of events and the columns that describe a row rather than belong to it.
EVENT_TYPES = ("data_point", "batch", "control", "heartbeat", "error")
METADATA = ("sensor_id", "timestamp", "status")
DLQ_SUFFIX = "__dlq"


def envelope(df: DataFrame, source: str, stream_id: Column | str | None = None, event_type: str = "data_point", metadata: tuple[str, ...] = METADATA, extra: dict[str, str] | None = None, timestamp: Column | None = None) -> DataFrame:
    """stream_id, timestamp, source, event_type, data (struct), metadata (map of text)."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type}")
    cols = [c for c in df.columns if not c.startswith("_")]
    own = [c for c in cols if c not in metadata]
    meta = [x for c in cols if c in metadata for x in (F.lit(c), F.col(c).cast("string"))] + [x for k, v in (extra or {}).items() for x in (F.lit(k), F.lit(v))]
    sid = F.expr("uuid()") if stream_id is None else F.lit(stream_id) if isinstance(stream_id, str) else stream_id
    return df.select(
        sid.alias("stream_id"), (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"), F.lit(source).alias("source"), F.lit(event_type).alias("event_type"),
        (F.struct(*own) if own else F.struct(F.lit(None).cast("string").alias("empty"))).alias("data"), (F.create_map(*meta) if meta else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def serialized(messages: DataFrame) -> DataFrame:
    """value: the message as JSON."""
    return messages.select(F.to_json(F.struct(*messages.columns)).alias("value"))


def topic(exchange: Column, routing_key: Column) -> Column:
    return F.replace(F.lower(F.concat_ws("__", exchange, routing_key)), F.lit("-"), F.lit("_"))


def dead_letter_topic(name: Column) -> Column:
    return F.concat(name, F.lit(DLQ_SUFFIX))
