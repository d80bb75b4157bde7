"""Streams in the order of event time: rows wait in state for the watermark, late ones go to a side output.

Spark drops rows behind the watermark before a stateful operator sees them. Here the watermark is carried by tick rows,
one for each batch of rows that a task reads, while the rows themselves have no event time for
Spark: the processor gets all of them, holds the punctual ones until the watermark has passed them (an event-time
timer for each key), and hands late ones on at once, tagged. So every row comes out once: punctual or late.

State is kept in RocksDB (``spark.sql.streaming.stateStore.providerClass``), which ``session_conf`` names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import orderstats as O
from millrace.operators import audit as A
from millrace.operators.windows import duration

SIMPLE = ("count", "sum", "mean", "min", "max", "std", "var", "first", "last")
FUNCTIONS = (*SIMPLE, "median", *O.PERCENTILES, "unique", "top_k")
#: What a late row is reported under.
LATE = "late"
#: Milliseconds of event time whose waiting rows lie together; rows that are released at a time, about.
SLOT, RELEASED = 3_600_000, 200_000
#: State of the sums: rows, first value, differences from it, their squares, extremes, first and last value.
SUMS = "n long, k double, d double, q double, lo double, hi double, f double, l double"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with timers need it; state of other queries is not touched until they start anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ticked(df: DataFrame, time: str, delay: float) -> DataFrame:
    """``df`` with _at (event time in milliseconds), _tick and the watermark's column _mark: null but in ticks, copies of the latest row of each batch."""
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withColumns({"_at": F.unix_millis(F.col(time)), "_tick": F.lit(False), "_mark": F.lit(None).cast("timestamp")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            if batch.num_rows and (top := pc.max(batch.column("_at")).as_py()) is not None:
                last = batch.slice(pc.index(batch.column("_at"), top).as_py(), 1)
                mark = pa.array([top], pa.timestamp("ms", tz="UTC"))
                for name, made in (("_tick", pa.array([True])), ("_mark", mark)):
                    field = batch.schema.field(name)
                    last = last.set_column(batch.schema.get_field_index(name), field, made.cast(field.type))
                yield last

    return rows.mapInArrow(run, rows.schema).withWatermark("_mark", f"{delay} seconds")


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Held(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them; then they come in order, through ``released``.

    They wait packed, those of a micro-batch and an hour of event time together, and are read again hour by hour.
    """

    def __init__(self, columns: list[str], order: str, held: T.StructType, idle: float | None = None) -> None:
        self.columns, self.order, self.schema, self.idle = columns, order, held, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "parts int, low long")
        self.waiting = handle.getMapState("held", "slot long, part int", "rows binary")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Further state."""

    def released(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        return rows

    def forgotten(self) -> None:
        """A key's state when it has been idle."""

    def timer_at(self, want: int | None, passed: int) -> None:
        """One timer ahead for each key: at the next row to be released, else (with ``idle``) at the end of the key's state. Those that are due fire after a batch's rows."""
        ahead = [t for t in self.handle.listTimers() if t > passed]
        for t in ahead:
            if t != want:
                self.handle.deleteTimer(t)
        if want is not None and want not in ahead:
            self.handle.registerTimer(want)

    def arrived(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The rows without ticks; Spark renames columns that begin with an underscore, so they are named by place."""
        new = pd.concat([x.set_axis([*self.columns, "_at", "_tick", "_mark"], axis=1) for x in rows], ignore_index=True)
        return new[~new["_tick"].astype(bool)][[*self.columns, "_at"]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = self.arrived(rows)
        if not len(new):
            return
        late = (new["_at"] < passed) | new["_at"].isna()
        if late.any():
            yield self.tagged(new[late])
        new = new[~late]
        if len(new):
            known = self.slots.exists()
            for slot, part in new.groupby(new["_at"].astype("int64") // SLOT):
                at = (int(slot),)
                parts, low = self.slots.getValue(at) if known and self.slots.containsKey(at) else (0, int(part["_at"].min()))
                self.waiting.updateValue((int(slot), int(parts)), (packed(part),))
                self.slots.updateValue(at, (int(parts) + 1, min(int(low), int(part["_at"].min()))))
            first = int(new["_at"].min()) + 1
            held = [t for t in self.handle.listTimers() if t > passed] if known else []
            self.timer_at(min([first, *held]), passed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        slots = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.slots.iterator()}
        if not slots:
            self.forgotten()
            self.timer_at(None, passed)
            return
        out: list[pd.DataFrame] = []
        last = passed
        for slot in sorted(s for s, (_, low) in slots.items() if low < passed):
            rows = pd.concat([unpacked(bytes(self.waiting.getValue((slot, p))[0])) for p in range(slots[slot][0])], ignore_index=True)
            for p in range(slots[slot][0]):
                self.waiting.removeKey((slot, p))
            due = rows["_at"] < passed
            rest = rows[~due]
            if len(rest):
                slots[slot] = (1, int(rest["_at"].min()))
                self.waiting.updateValue((slot, 0), (packed(rest),))
                self.slots.updateValue((slot,), slots[slot])
            else:
                del slots[slot]
                self.slots.removeKey((slot,))
            out.append(rows[due].sort_values(["_at", self.order], kind="stable"))
            last = int(out[-1]["_at"].max())
            if sum(map(len, out)) >= RELEASED:
                yield self.tagged(self.released(key, pd.concat(out, ignore_index=True)), late=False)
                out = []
        if out:
            yield self.tagged(self.released(key, pd.concat(out, ignore_index=True)), late=False)
        if slots:
            self.timer_at(min(low for _, low in slots.values()) + 1, passed)
        else:
            self.timer_at(None if self.idle is None else max(last + int(self.idle * 1000), passed) + 1, passed)

    def tagged(self, rows: pd.DataFrame, late: bool = True) -> pd.DataFrame:
        out = rows.drop(columns="_at")
        out["_late"] = late
        for f in self.made:
            if f not in out:
                out[f] = None
        return out[[*self.columns, "_late", *self.made]]

    made: dict[str, str] = {}

    def close(self) -> None:
        pass


class HeldAggregates(Held):
    """Running values of each key in order, over all micro-batches: sums in a value, values' counts in a map."""

    def __init__(self, columns: list[str], order: str, held: T.StructType, source: str, names: dict[str, str], idle: float | None, top: int) -> None:
        super().__init__(columns, order, held, idle)
        self.source, self.names, self.top = source, names, top
        self.made = names
        self.counted = [f for f in names.values() if f not in SIMPLE]

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)
        if self.counted:
            self.counts = handle.getMapState("counts", "v double", "n long, since long")

    def forgotten(self) -> None:
        self.sums.clear()
        if self.counted:
            self.counts.clear()

    def released(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[self.source].astype(float).to_numpy()
        known = ~np.isnan(x)
        n0, k, d0, q0, lo, hi, first, last = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, np.inf, -np.inf, np.nan, np.nan)
        if not n0 and known.any():
            k = first = float(x[known][0])
        v = np.where(known, x - k, 0.0)
        n, d, q = n0 + np.cumsum(known), d0 + np.cumsum(v), q0 + np.cumsum(v * v)
        low, high = np.minimum.accumulate(np.where(known, x, np.inf)).clip(max=lo), np.maximum.accumulate(np.where(known, x, -np.inf)).clip(min=hi)
        if known.any():
            last = float(x[known][-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.clip(q / n - (d / n) ** 2, 0, None)
            found = {"count": n, "sum": d + k * n, "mean": k + d / n, "min": low, "max": high, "std": np.sqrt(var), "var": var, "first": np.full(len(x), first), "last": x}
        if self.counted:
            found |= self.ranked(x, known, n0)
        self.sums.update((int(n[-1]), float(k), float(d[-1]), float(q[-1]), float(low[-1]), float(high[-1]), float(first), float(last)))
        out = rows.copy()
        for name, f in self.names.items():
            values = pd.Series(found[f], index=out.index, dtype=object if f == "top_k" else None)
            out[name] = values.where(known, None)
        return out

    def ranked(self, x: np.ndarray, known: np.ndarray, n0: int) -> dict[str, Any]:
        """Order statistics, distinct counts and most frequent values of each prefix: the earlier values' counts are read once for all released rows."""
        old = {float(k[0]): (int(c[0]), int(c[1])) for k, c in self.counts.iterator()}
        values, at = np.unique(x[known], return_inverse=True)
        new = np.array([v not in old for v in values.tolist()], bool)
        firsts = np.zeros(len(x), bool)
        firsts[np.flatnonzero(known)[np.unique(at, return_index=True)[1]]] = new
        out: dict[str, Any] = {"unique": len(old) + np.cumsum(firsts)}
        kinds = [f for f in self.counted if f in O.PLACES]
        out |= {f: np.full(len(x), np.nan) for f in kinds}
        if kinds and known.any():
            prior = np.array(sorted(old), float)
            held = np.array([old[v][0] for v in prior.tolist()], np.int64)
            ends = held.cumsum()
            upto = np.cumsum(known)
            for f in kinds:
                total = np.zeros(len(x))
                for place in O.PLACES[f]:
                    lo, hi = self.slice_of(place, n0, int(upto[-1]))
                    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "right") + 1
                    below = int(ends[a - 1]) if a else 0
                    line = np.r_[np.repeat(prior[a:b], held[a:b]), x[known]]
                    order = np.argsort(line, kind="stable")
                    symbols = np.empty(len(line), np.int64)
                    symbols[order] = np.arange(len(line))
                    some = np.flatnonzero(n0 + upto > 0)
                    right = len(line) - int(upto[-1]) + upto[some]
                    total[some] += line[order][O.selected(symbols, np.zeros(len(some), np.int64), right, place(n0 + upto[some]) - below)]
                out[f] = total / len(O.PLACES[f])
        if "top_k" in self.counted:
            out["top_k"] = self.tops(x, known, dict(old), n0)
        changed = dict(zip(values.tolist(), np.bincount(at, minlength=len(values)).tolist(), strict=True))
        place = {v: n0 + int(i) for v, i in zip(values.tolist(), np.unique(at, return_index=True)[1], strict=True)}
        for v, c in changed.items():
            had = old.get(v, (0, place[v]))
            self.counts.updateValue((v,), (had[0] + c, had[1]))
        return out

    @staticmethod
    def slice_of(place: Any, n0: int, m: int) -> tuple[int, int]:
        top = int(place(np.array([n0 + m]))[0])
        return max(0, top - m - 2), top + 2

    def tops(self, x: np.ndarray, known: np.ndarray, counts: dict[float, tuple[int, int]], n0: int) -> list:
        """The most frequent values so far (ties: seen first), as text: only values of the release and the old leaders can lead."""
        leaders = sorted(counts, key=lambda v: (-counts[v][0], counts[v][1]))[: self.top]
        out: list = []
        seen = n0
        for v, k in zip(x.tolist(), known.tolist(), strict=True):
            if k:
                c, since = counts.get(v, (0, seen))
                counts[v] = (c + 1, since)
                seen += 1
                leaders = sorted({*leaders, v}, key=lambda u: (-counts[u][0], counts[u][1]))[: self.top]
            out.append(",".join(f"{u:g}:{counts[u][0]}" for u in leaders) if k else None)
        return out


class Windows(Held):
    """Tumbling windows at their close; rows of windows that are closed are late."""

    def __init__(self, columns: list[str], order: str, held: T.StructType, source: str, size: int, names: dict[str, str]) -> None:
        super().__init__(columns, order, held)
        self.source, self.size, self.names = source, size, names
        self.made = {"window_start": "", **names}

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "start long", SUMS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = self.arrived(rows)
        if not len(new):
            return
        start = np.floor_divide(new["_at"], self.size) * self.size
        late = new["_at"].isna() | (start + self.size <= passed)
        if late.any():
            yield self.tagged(new[late])
        for s, part in new[~late].groupby(start[~late]):
            x = part.sort_values(["_at", self.order])[self.source].astype(float).dropna().to_numpy()
            n, k, d, q, lo, hi, f, last = self.open.getValue((int(s),)) if self.open.containsKey((int(s),)) else (0, 0.0, 0.0, 0.0, np.inf, -np.inf, np.nan, np.nan)
            if len(x):
                k = k if n else float(x[0])
                v = x - k
                n, d, q, lo, hi = n + len(x), d + float(v.sum()), q + float((v * v).sum()), min(lo, float(x.min())), max(hi, float(x.max()))
            self.open.updateValue((int(s),), (int(n), k, d, q, lo, hi, f, last))
            self.handle.registerTimer(int(s) + self.size)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.size
        if not self.open.containsKey((start,)):
            return
        n, k, d, q, lo, hi, *_ = self.open.getValue((start,))
        self.open.removeKey((start,))
        var = max(q / n - (d / n) ** 2, 0.0) * n / (n - 1) if n > 1 else 0.0
        made = {"count": n, "sum": d + k * n if n else None, "mean": k + d / n if n else None, "min": lo if n else None, "max": hi if n else None, "std": var**0.5, "var": var}
        out = pd.DataFrame([{c: None for c in self.columns} | {"_late": False, "window_start": pd.Timestamp(start, unit="ms")} | {name: made[f] for name, f in self.names.items()}])
        keys = key if isinstance(key, tuple) else (key,)
        for c, v in zip(self.columns, keys, strict=False):
            out[c] = v
        yield out[[*self.columns, "_late", *self.made]]


def _started(df: DataFrame, groups: list[str], time: str, delay: str | float, processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    use_rocksdb(df.sparkSession)
    rows = ticked(df, time, duration(delay))
    out = rows.groupBy(*groups).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    late = A.item("stream", time, LATE, F.col(time))
    errors = F.when(F.col("_late"), F.array(late)).otherwise(F.array().cast(A.ITEM))
    return out.withColumns({A.ERRORS: errors, A.WARNINGS: F.array().cast(A.ITEM), A.VALID: ~F.col("_late")}).drop("_late")


def in_order(df: DataFrame, groups: list[str], source: str, time: str, order: str, name: str, functions: list[str], delay: str | float, keep: list[str] | None = None, idle: float | None = None, top: int = 5) -> DataFrame:
    """Rows with <name>_<function> of the rows of their group up to them in (``time``, ``order``), whatever micro-batch brought them.

    A row comes out when the watermark (the latest time seen, less ``delay``) has passed it; rows that arrive behind the watermark, or without
    a time, come out at once as invalid rows with the error ``late``, so that ``query.start(..., rejected=...)`` writes them to their own
    folder. ``idle``: seconds of event time without rows after which a group's state is dropped. top_k is text, value:count by rank.
    """
    unknown = [f for f in functions if f not in FUNCTIONS]
    if unknown:
        raise ValueError(f"no ordered form: {unknown}")
    columns = list(dict.fromkeys([*groups, time, order, source, *(keep or [])]))
    fields = [T.StructField(c, T.TimestampType() if c == time else df.schema[c].dataType) for c in columns]
    kind = lambda f: T.StringType() if f == "top_k" else T.LongType() if f in ("count", "unique") else T.DoubleType()
    names = {f"{name}_{f}": f for f in functions}
    schema = T.StructType([*fields, T.StructField("_late", T.BooleanType()), *[T.StructField(n, kind(f)) for n, f in names.items()]])
    processor = HeldAggregates(columns, order, T.StructType([*fields, T.StructField("_at", T.LongType())]), source, names, idle, top)
    return _started(df.select(*columns), groups, time, delay, processor, schema)


def at_close(df: DataFrame, groups: list[str], source: str, time: str, order: str, size: str | float, name: str, functions: list[str], delay: str | float) -> DataFrame:
    """A valid row for each closed tumbling window of each group (window_start, <name>_<function>), and an invalid one for each row that came after its window's close."""
    columns = list(dict.fromkeys([*groups, time, order, source]))
    fields = [T.StructField(c, T.TimestampType() if c == time else df.schema[c].dataType) for c in columns]
    names = {f"{name}_{f}": f for f in functions}
    kind = lambda f: T.LongType() if f == "count" else T.DoubleType()
    schema = T.StructType([*fields, T.StructField("_late", T.BooleanType()), T.StructField("window_start", T.TimestampType()), *[T.StructField(n, kind(f)) for n, f in names.items()]])
    processor = Windows(columns, order, T.StructType([*fields, T.StructField("_at", T.LongType())]), source, int(duration(size) * 1000), names)
    return _started(df.select(*columns), groups, time, delay, processor, schema)
