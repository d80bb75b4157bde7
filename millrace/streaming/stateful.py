"""Stateful streams: deduplication, windows at their close, and running aggregates for each row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.windows import TimeWindow, closed, duration


def zoned(df: DataFrame, time: str) -> DataFrame:
    """Event times must be zoned timestamps to carry a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def dedup(df: DataFrame, keys: list[str], time: str, delay: str | float) -> DataFrame:
    """The first row of each key; state of keys older than the watermark is dropped."""
    return zoned(df, time).withWatermark(time, f"{duration(delay)} seconds").dropDuplicatesWithinWatermark(keys)


def at_close(df: DataFrame, w: TimeWindow, delay: str | float | None = None) -> DataFrame:
    """Windows as they close: append mode, late rows beyond the watermark are left out and counted in the query's status (late_rows)."""
    wait = duration(delay if delay is not None else w.watermark or 0)
    return closed(zoned(df, w.time).withWatermark(w.time, f"{wait} seconds"), w)


STATE = "n bigint, k double, d double, q double, lo double, hi double"
MADE = ("count", "sum", "mean", "min", "max", "std")


def running(df: DataFrame, groups: list[str], source: str, order: str, name: str, keep: list[str] | None = None, ttl: float | None = None) -> DataFrame:
    """groups, kept columns, order, source and <name>_count ... <name>_std up to each row of its group.

    Within a micro-batch rows of a group are taken in ``order``; the state holds six numbers for each group: sums are
    those of differences from the group's first value, so that deviations stay exact. ``ttl``: seconds without rows after
    which a group's state is dropped (its next row starts anew); without it state grows with the number of groups. With it the
    query needs a polling interval, as time may always bring another batch.
    """
    keep = [c for c in keep or [] if c not in (*groups, order, source)]
    cols = [*groups, *keep, order, source]
    fields = [df.schema[c] for c in cols]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(f"{name}_count", T.LongType()), *[T.StructField(f"{name}_{m}", T.DoubleType()) for m in MADE[1:]]])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        x = rows[source].astype(float)
        known = x.notna()
        first = float(x[known].iloc[0]) if known.any() else 0.0
        n, k, d, q, lo, hi = state.get if state.exists else (0, first, 0.0, 0.0, float("inf"), float("-inf"))
        if n == 0:
            k = first
        out = rows[cols].copy()
        v = (x - k).fillna(0.0)
        count, total, square = n + known.cumsum(), d + v.cumsum(), q + (v * v).cumsum()
        low = x.fillna(float("inf")).cummin().clip(upper=lo)
        high = x.fillna(float("-inf")).cummax().clip(lower=hi)
        state.update((int(count.iloc[-1]), k, float(total.iloc[-1]), float(square.iloc[-1]), float(low.iloc[-1]), float(high.iloc[-1])))
        if ttl is not None:
            state.setTimeoutDuration(int(ttl * 1000))
        seen = count.where(count > 0)
        mean = k + total / seen
        made = {"count": count, "sum": total + k * count, "mean": mean, "min": low, "max": high, "std": (square / seen - (total / seen) ** 2).clip(lower=0) ** 0.5}
        for m in MADE:
            out[f"{name}_{m}"] = made[m].where(known) if m != "count" else made[m]
        yield out

    wait = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.select(*cols).groupBy(*groups).applyInPandasWithState(update, schema, STATE, "append", wait)
