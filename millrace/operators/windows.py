"""Time-window features: tumbling, sliding, hopping, session and global, for each row or at the window's close."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ordered as D
from millrace.functions import orderstats as O
from millrace.functions import running as R
from millrace.operators.aggregates import micros, seconds

TYPES = ("tumbling", "sliding", "session", "global")
FUNCTIONS = ("count", "sum", "mean", "min", "max", "std", "var", "first", "last", "median", *O.PERCENTILES, "unique", "rate")
_UNITS = {"s": 1, "second": 1, "sec": 1, "m": 60, "minute": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "week": 604800, "w": 604800}


def duration(v) -> float | None:
    """Seconds of a number, a timedelta, or text such as "90", "5 minutes", "1h"."""
    if v is None or isinstance(v, (int, float)):
        return v
    if hasattr(v, "total_seconds"):
        return v.total_seconds()
    parts = re.findall(r"([0-9.]+)\s*([a-zA-Z]*)", str(v))
    if not parts:
        raise ValueError(f"no duration: {v}")
    return sum(float(n) * _UNITS[u.lower().rstrip("s") or "s"] for n, u in parts)


@dataclass(frozen=True)
class TimeWindow:
    name: str
    source: str
    time: str
    type: str = "sliding"
    size: float | None = None
    slide: float | None = None
    functions: list[str] = field(default_factory=lambda: ["count", "mean"])
    group_by: list[str] = field(default_factory=list)
    watermark: float | None = None
    emit_on_close: bool = False


def minutes(first: Column, last: Column) -> Column:
    """From one time in microseconds to another; whole numbers are subtracted, as seconds of today's times have no exact microseconds."""
    return (last - first) / 6e7


def per_minute(n: Column, span: Column) -> Column:
    return F.when(n < 2, 0.0).when(span <= 0, n.cast("double")).otherwise(n / span)


def _made(frame, x: Column, at: Column) -> dict[str, Column]:
    """Each function over a frame (``at``: the time in microseconds); deviations are the sample's."""
    n = F.count(x).over(frame)
    span = minutes(F.min(at).over(frame), F.max(at).over(frame))
    return {
        "count": n, "sum": F.sum(x).over(frame), "mean": F.avg(x).over(frame), "min": F.min(x).over(frame), "max": F.max(x).over(frame),
        "std": F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0)), "var": F.coalesce(F.var_samp(x).over(frame), F.lit(0.0)),
        "first": F.first(x, ignorenulls=True).over(frame), "last": F.last(x, ignorenulls=True).over(frame),
        "rate": per_minute(n, span),
    }


def session_ids(df: DataFrame, time: str, groups: list[str], gap: float, order: str, parts: int | None = None) -> DataFrame:
    """``df`` with _session: a gap strictly longer than ``gap`` seconds starts a new one.

    Gaps and numbers are carried between blocks of (group, time), so a session and a group may span any number of them.
    """
    t = seconds(F.col(time))
    before, new = D.fresh(df, "_before"), D.fresh(df, "_new")
    rows = R.Blocks.of(df, [F.col(g) for g in groups], [t, F.col(order)], parts).running({before: ("last", t)}, inclusive=False)
    rows = R.Blocks(rows.df.withColumn(new, F.when(t - F.col(before) > gap, 1).otherwise(0)), rows.names, rows.group, rows.pos)
    return rows.running({"_session": ("sum", F.col(new))}).rows("_session").withColumn("_session", F.col("_session").cast("long"))


def running(df: DataFrame, w: TimeWindow, order: str) -> DataFrame:
    """``df`` with <name>_<function> of the window as it stands at each row; null where source or time is null."""
    if w.type not in TYPES:
        raise ValueError(f"unknown window type {w.type}")
    x, t, at = F.col(w.source).try_cast("double"), seconds(F.col(w.time)), micros(F.col(w.time))
    size = duration(w.size)
    x = F.when(t.isNotNull(), x)
    keys, sorts, back = [F.col(g) for g in w.group_by], [t, F.col(order)], None
    if w.type == "session":
        df = session_ids(df, w.time, w.group_by, size, order)
        keys.append(F.col("_session"))
    elif w.type == "tumbling":
        keys.append(F.floor(t / size))
    elif w.type == "sliding" or w.watermark is not None:
        back = round((size if w.type == "sliding" else duration(w.watermark)) * 1e6)
        sorts[0] = at
    frame = Window.partitionBy(*keys)
    frame = frame.orderBy(*sorts).rowsBetween(Window.unboundedPreceding, 0) if back is None else frame.orderBy(sorts[0]).rangeBetween(-back, 0)
    ranks = {f"{w.name}_{f}": f for f in w.functions if f == "median" or f in O.PERCENTILES or (f == "unique" and back is not None)}
    if ranks:
        df = O.running_statistics(df, keys, sorts, x, ranks, back)
    if "unique" in w.functions and back is None:
        df = O.running_unique(df, keys, sorts, x, [f"{w.name}_unique"], None)
        ranks[f"{w.name}_unique"] = "unique"
    rest = [f for f in w.functions if f not in ranks.values()]
    name = lambda f: f"{w.name}_{f}"
    if rest and back is not None and not keys:
        df = _trailing(df, x, at, back, {f: name(f) for f in rest})
    elif rest and not keys:
        df = _global(df, w, sorts, x, at, rest)
    else:
        made = _made(frame, x, at)
        df = df.withColumns({name(f): made[f] for f in rest})
    return df.withColumns({name(f): F.when(x.isNotNull(), F.col(name(f)).cast("int") if f == "unique" else F.col(name(f))) for f in w.functions}).drop("_session")


def _trailing(df: DataFrame, x: Column, at: Column, back: int, names: dict[str, str]) -> DataFrame:
    """Trailing frames without a group: totals by ``trailing_totals``, which skips what a frame holds between its ends; deviations, first and last by windows."""
    uses = {"count": ["n"], "sum": ["s"], "mean": ["s", "n"], "min": ["lo"], "max": ["hi"], "rate": ["n", "t"]}
    parts = {"n": ("count", x), "s": ("sum", x), "lo": ("min", x), "hi": ("max", x), "t": ("min", at)}
    plain = [f for f in names if f not in uses]
    if plain:
        df = R.trailing(df, [], at, back, lambda over: {names[f]: v for f, v in _made(over, x, at).items() if f in plain})
    kept = {k: D.fresh(df, f"_{k}") for k in parts if any(k in uses.get(f, []) for f in names)}
    if not kept:
        return df
    df = R.trailing_totals(df, [], at, back, {c: parts[k] for k, c in kept.items()})
    v = {k: F.col(c) for k, c in kept.items()}
    made = {"count": lambda: v["n"], "sum": lambda: v["s"], "mean": lambda: v["s"] / v["n"], "min": lambda: v["lo"], "max": lambda: v["hi"], "rate": lambda: per_minute(v["n"], minutes(v["t"], at))}
    return df.withColumns({names[f]: made[f]() for f in names if f in uses}).drop(*kept.values())


def _global(df: DataFrame, w: TimeWindow, sorts: list[Column], x: Column, at: Column, functions: list[str]) -> DataFrame:
    """All rows so far without a group, by blocks."""
    parts = {"n": ("count", x), "s": ("sum", x), "q": ("sum", x * x), "lo": ("min", x), "hi": ("max", x), "f": ("first", x), "l": ("last", x), "t0": ("min", at), "t1": ("max", at)}
    names = {k: D.fresh(df, f"_{k}") for k in parts}
    out = R.Blocks.of(df, [], sorts).running({names[k]: p for k, p in parts.items()}).rows(*names.values())
    v = {k: F.col(c) for k, c in names.items()}
    var = F.when(v["n"] > 1, F.greatest((v["q"] - v["s"] * v["s"] / v["n"]) / (v["n"] - 1), F.lit(0.0))).otherwise(0.0)
    span = minutes(v["t0"], v["t1"])
    made = {
        "count": v["n"], "sum": v["s"], "mean": v["s"] / v["n"], "min": v["lo"], "max": v["hi"], "std": F.sqrt(var), "var": var, "first": v["f"], "last": v["l"],
        "rate": per_minute(v["n"], span),
    }
    return out.withColumns({f"{w.name}_{f}": made[f] for f in functions}).drop(*names.values())


def closed(df: DataFrame, w: TimeWindow) -> DataFrame:
    """One row for each group and window: window_start (and window_end), <name>_<function>. Also for streams.

    Median and percentiles come by ranks; in streams and in sessions, whose windows must hold their values anyway, from those.
    """
    size = f"{duration(w.size)} seconds"
    if w.type == "session":
        key = F.session_window(w.time, size)
    elif w.slide is not None:
        key = F.window(w.time, size, f"{duration(w.slide)} seconds")
    else:
        key = F.window(w.time, size)
    x = F.col(w.source).try_cast("double")
    t = F.when(x.isNotNull(), micros(F.col(w.time)))
    n = F.count(x)
    span = minutes(F.min(t), F.max(t))
    made = {
        "count": n, "sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.coalesce(F.stddev_samp(x), F.lit(0.0)), "var": F.coalesce(F.var_samp(x), F.lit(0.0)),
        "first": F.min_by(x, t), "last": F.max_by(x, t), "unique": F.count_distinct(x), "rate": per_minute(n, span),
    }
    ranks = [f for f in w.functions if f == "median" or f in O.PERCENTILES]
    if df.isStreaming or w.type == "session":
        made |= {"median": F.median(x)} | {k: O.pick(F.collect_list(x), p) for k, p in O.PERCENTILES.items()}
        ranks = []
    plain = [f for f in w.functions if f not in ranks] or ["count"]
    out = df.groupBy(key.alias("w"), *w.group_by).agg(*[made[f].alias(f"{w.name}_{f}") for f in plain])
    out = out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *w.group_by, *[f"{w.name}_{f}" for f in plain])
    if ranks:
        placed = df.select(key.alias("w"), *w.group_by, x.alias("_x")).select(F.col("w.start").alias("window_start"), *w.group_by, "_x")
        groups = ["window_start", *w.group_by]
        got = O.group_statistics(placed, groups, "_x", ranks)
        got = got.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *[F.col(f).alias(f"{w.name}_{f}") for f in ranks])
        on = F.lit(True)
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = out.join(got, on, "left")
    return out.select("window_start", "window_end", *w.group_by, *[f"{w.name}_{f}" for f in w.functions])
