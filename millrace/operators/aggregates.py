"""Keyed aggregations: running values for each row, or one row for each group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ordered as D
from millrace.functions import orderstats as O
from millrace.functions import running as R

SIMPLE = ("count", "sum", "mean", "min", "max", "std", "var", "first", "last")
FUNCTIONS = (*SIMPLE, "median", *O.PERCENTILES, "rate", "unique", "top_k")


@dataclass(frozen=True)
class Aggregation:
    """``window`` (seconds) bounds the timestamps that rate spans; the count stays the lifetime's unless ``strict_window``."""

    name: str
    source: str
    group_by: list[str] = field(default_factory=list)
    functions: list[str] = field(default_factory=lambda: ["count", "mean"])
    time: str | None = None
    window: float | None = None
    strict_window: bool = False
    emit_on_change: bool = False


def population(n: Column, s: Column, q: Column) -> Column:
    """Population variance from count, sum and sum of squares; 0 for one value."""
    return F.when(n > 1, F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).otherwise(0.0)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def seconds(c: Column) -> Column:
    return micros(c) / 1e6


def running(df: DataFrame, agg: Aggregation, order: str, hot: bool = False) -> DataFrame:
    """``df`` with <name>_<function> of the rows of its group up to each row; null where the source is null.

    Without groups, or if ``hot`` says that a group may be too large for one task, rows go by blocks that groups span. Order statistics and
    distinct counts always do.
    """
    unknown = [f for f in agg.functions if f not in FUNCTIONS or f == "top_k"]
    if unknown:
        raise ValueError(f"no running form: {unknown}")
    c = F.col(agg.source)
    groups = [F.col(g) for g in agg.group_by]
    ranks = {f"{agg.name}_{f}": f for f in agg.functions if f in ("median", *O.PERCENTILES)}
    if ranks:
        df = O.running_statistics(df, groups, [F.col(order)], c.try_cast("double"), ranks)
    if "unique" in agg.functions:
        df = O.running_unique(df, groups, [F.col(order)], c, [f"{agg.name}_unique"], None)
        ranks[f"{agg.name}_unique"] = "unique"
    rest = [f for f in agg.functions if f not in ranks.values()]
    if rest:
        df = _by_blocks(df, agg, order, rest) if hot or not groups else _by_window(df, agg, order, rest)
    got = {f: F.col(f"{agg.name}_{f}") for f in agg.functions}
    return df.withColumns({f"{agg.name}_{f}": F.when(c.isNotNull(), v.cast("int") if f == "unique" else v) for f, v in got.items()})


def _by_window(df: DataFrame, agg: Aggregation, order: str, functions: list[str]) -> DataFrame:
    c = F.col(agg.source)
    x = c.try_cast("double")
    w = Window.partitionBy(*agg.group_by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(c).over(w)
    made = {
        "count": lambda: n, "sum": lambda: F.coalesce(F.sum(x).over(w), F.lit(0.0)), "mean": lambda: F.avg(x).over(w), "min": lambda: F.min(x).over(w), "max": lambda: F.max(x).over(w),
        "std": lambda: F.coalesce(F.stddev_pop(x).over(w), F.lit(0.0)), "var": lambda: F.coalesce(F.var_pop(x).over(w), F.lit(0.0)),
        "first": lambda: F.first(c, ignorenulls=True).over(w), "last": lambda: F.last(c, ignorenulls=True).over(w), "rate": lambda: rate(agg, order, c, n),
    }
    return df.withColumns({f"{agg.name}_{f}": made[f]() for f in functions})


def _by_blocks(df: DataFrame, agg: Aggregation, order: str, functions: list[str]) -> DataFrame:
    c, groups = F.col(agg.source), [F.col(g) for g in agg.group_by]
    x = c.try_cast("double")
    t = F.when(c.isNotNull(), seconds(F.col(agg.time))) if agg.time else F.lit(None).cast("double")
    parts = {"n": ("count", c), "s": ("sum", x), "q": ("sum", x * x), "lo": ("min", x), "hi": ("max", x), "f": ("first", c), "l": ("last", c), "tf": ("first", t), "tn": ("count", t)}
    uses = {"count": "n", "sum": "s", "mean": "sn", "min": "lo", "max": "hi", "std": "snq", "var": "snq", "first": "f", "last": "l", "rate": "n"}
    names = {k: D.fresh(df, f"_{k}") for k in parts}
    kept = [k for k in parts if any(k in uses[f] for f in functions) or ("rate" in functions and k in ("tf", "tn"))]
    df = R.Blocks.of(df, groups, [F.col(order)]).running({names[k]: parts[k] for k in kept}).rows(*[names[k] for k in kept])
    v = {k: F.col(names[k]) for k in kept}
    made = {}
    for f in functions:
        if f in ("std", "var"):
            var = population(v["n"], v["s"], v["q"])
            made[f] = F.sqrt(var) if f == "std" else var
        elif f == "mean":
            made[f] = v["s"] / v["n"]
        elif f != "rate":
            made[f] = v[uses[f]]
        elif agg.time is None:
            made[f] = F.lit(0.0)
        elif agg.window is None:
            made[f] = per_minute(v["n"], v["tn"], t - v["tf"])
    if "rate" in functions and agg.time is not None and agg.window is not None:
        low, n = D.fresh(df, "_low"), D.fresh(df, "_kept")
        df = R.trailing_totals(df, groups, micros(F.col(agg.time)), round(agg.window * 1e6), {low: ("min", t), n: ("count", t)})
        made["rate"] = per_minute(F.col(n) if agg.strict_window else v["n"], F.col(n), t - F.col(low))
        return df.withColumns({f"{agg.name}_{f}": m for f, m in made.items()}).drop(*names.values(), low, n)
    return df.withColumns({f"{agg.name}_{f}": m for f, m in made.items()}).drop(*names.values())


def per_minute(n: Column, kept: Column, span: Column) -> Column:
    """n over a span of seconds, as a number a minute; fewer than two kept: 0; no span: the count."""
    return F.when(kept < 2, 0.0).when(span <= 0, n.cast("double")).otherwise(n / (span / 60))


def rate(agg: Aggregation, order: str, c: Column, n: Column) -> Column:
    """Events a minute over the span of the kept timestamps; fewer than two: 0; no span: the count."""
    if agg.time is None:
        return F.lit(0.0)
    t = F.when(c.isNotNull(), seconds(F.col(agg.time)))
    if agg.window is None:
        w = Window.partitionBy(*agg.group_by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first, kept = F.first(t, ignorenulls=True).over(w), F.count(t).over(w)
    else:
        w = Window.partitionBy(*agg.group_by).orderBy(micros(F.col(agg.time))).rangeBetween(-round(agg.window * 1e6), 0)
        first, kept = F.min(t).over(w), F.count(t).over(w)
        n = kept if agg.strict_window else n
    return per_minute(n, kept, t - first)


def grouped(df: DataFrame, agg: Aggregation, order: str) -> DataFrame:
    """One row for each group (null is a group): partial and final hash aggregation; median and percentiles by ranks."""
    c = F.col(agg.source)
    x = c.try_cast("double")
    at = F.when(c.isNotNull(), F.col(order))
    n = F.count(c)
    made = {
        "count": n, "sum": F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.coalesce(F.stddev_pop(x), F.lit(0.0)), "var": F.coalesce(F.var_pop(x), F.lit(0.0)),
        "first": F.min_by(c, at), "last": F.max_by(c, at), "unique": F.count_distinct(c),
    }
    if agg.time:
        t = F.when(c.isNotNull(), seconds(F.col(agg.time)))
        span = (F.max_by(t, at) - F.min_by(t, at)) / 60
        made["rate"] = F.when(F.count(t) < 2, 0.0).when(span <= 0, n.cast("double")).otherwise(n / span)
    plain = [f for f in agg.functions if f in made]
    out = df.groupBy(*agg.group_by).agg(*[made[f].alias(f"{agg.name}_{f}") for f in plain]) if plain else None
    ranks = [f for f in agg.functions if f == "median" or f in O.PERCENTILES]
    if ranks:
        got = O.group_statistics(df.select(*agg.group_by, x.alias("_x")), agg.group_by, "_x", ranks)
        got = got.select(*[F.col(g).alias(f"_g_{g}") for g in agg.group_by], *[F.col(k).alias(f"{agg.name}_{k}") for k in ranks])
        if out is None:
            return got.withColumnsRenamed({f"_g_{g}": g for g in agg.group_by})
        on = F.lit(True)
        for g in agg.group_by:
            on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = out.join(got, on, "left").drop(*[f"_g_{g}" for g in agg.group_by])
    return out


def top_k(df: DataFrame, groups: list[str], value: str, order: str, k: int = 5) -> DataFrame:
    """groups, value, n, place: the k most frequent values of each group, ties by first appearance."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*groups).orderBy(F.desc("n"), "_first")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_first")


def top_k_map(df: DataFrame, groups: list[str], value: str, order: str, k: int = 5) -> DataFrame:
    """groups, top: the same as a map value -> count."""
    pairs = F.array_sort(F.collect_list(F.struct("place", F.col(value).cast("string").alias("v"), "n")))
    return top_k(df, groups, value, order, k).groupBy(*groups).agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["v"], p["n"]))).alias("top"))


def on_change(df: DataFrame, groups: list[str], order: str, column: str) -> DataFrame:
    """Only the rows at which ``column`` differs from the row before in its group."""
    before = F.lag(column).over(Window.partitionBy(*groups).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(order)) == 1
    return df.withColumn("_changed", first | ~F.col(column).eqNullSafe(before)).where("_changed").drop("_changed")
