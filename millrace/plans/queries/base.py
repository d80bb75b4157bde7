"""The registry and the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of (table reader) -> DataFrame under a name, with its SQL."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def events(t: Callable) -> DataFrame:
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def gappy(t: Callable) -> DataFrame:
    """event_id, user_id, event_type, v: every seventh value is null, every 13th NaN."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t("events").select("event_id", "user_id", "event_type", v.alias("v"))


GAPPY = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS v FROM events)"
