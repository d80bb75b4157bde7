"""Missing values: rejection, constants, statistics (over all rows or as seen so far), neighbours."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.functions import ordered as D
from millrace.functions import orderstats as O
from millrace.functions import running as R
from millrace.operators import audit as A
from millrace.session import written

STAGE = "missing"
STRATEGIES = ("reject", "fill_constant", "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward")
#: Rows after which running statistics are taken anew.
REFRESH = 100


def gap(df: DataFrame, c: str) -> Column:
    return K.is_missing(F.col(c), df.schema[c].dataType)


def value(df: DataFrame, c: str) -> Column:
    return F.when(~gap(df, c), F.col(c))


def statistic(df: DataFrame, c: str, strategy: str, order: str | None) -> Any:
    """One value for all rows: mean, median, or mode (ties: first in ``order``)."""
    v = value(df, c)
    number = K.to_float(v, df.schema[c].dataType)
    if strategy == "fill_mean":
        return df.agg(F.avg(number)).first()[0]
    if strategy == "fill_median":
        row = O.group_statistics(df.select(number.alias("_x")), [], "_x", ["median"]).first()
        return row.median if row else None
    first = F.min(order) if order else F.lit(0)
    top = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).orderBy(F.desc("n"), "first", "v").first()
    return top.v if top else None


def online(df: DataFrame, c: str, how: str, order: str, out: str, refresh: int = REFRESH, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: mean, median or mode of what had been seen at the last multiple of ``refresh`` rows, in the order of ``order``; null before it."""
    if order is None:
        raise ValueError(f"online {how} needs an order column")
    v = value(df, c)
    number = K.to_float(v, df.schema[c].dataType)
    row, s, n, m = (D.fresh(df, x) for x in ("_row", "_sum", "_n", "_at"))
    if how == "fill_mode":
        return online_mode(df, v, order, out, refresh, parts)
    if how == "fill_median":
        got = O.running_statistics(df, [], [F.col(order)], number, {m: "median"}, parts=parts)
        rows = R.Blocks.of(got, [], [F.col(order)], parts).running({row: ("count", F.lit(1)), m: ("last", F.col(m))})
        stat = F.col(m)
    else:
        rows = R.Blocks.of(df, [], [F.col(order)], parts).running({row: ("count", F.lit(1)), s: ("sum", number), n: ("count", number)})
        stat = F.try_divide(F.col(s), F.col(n))
    return rows.running({out: ("last", F.when(F.col(row) % refresh == 0, stat))}).rows(out).drop(m)


def online_mode(df: DataFrame, v: Column, order: str, out: str, refresh: int, parts: int | None) -> DataFrame:
    """The most frequent value so far, the one seen first of several, at refresh marks.

    Counts only rise, so the greatest (count, earlier first sight) that any value has had at any mark so far is the mode's of this mark:
    a running sum for each value, and a running maximum over marks.
    """
    row, x, mark, best = (D.fresh(df, c) for c in ("_row", "_x", "_mark", "_best"))
    rows = R.Blocks.of(df.withColumn(x, v), [], [F.col(order)], parts).running({row: ("count", F.lit(1))}).rows(x, row)
    rows = written(rows.withColumn(mark, F.floor(F.col(row) / refresh)), "online-mode")
    cells = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("v"), (F.floor((F.col(row) - 1) / refresh) + 1).alias("mark")).agg(F.count(F.lit(1)).alias("own"), F.min(row).alias("first"))
    line = R.Blocks.of(cells, [F.col("v")], [F.col("mark")], parts).running({"n": ("sum", F.col("own")), "since": ("first", F.col("first"))}).rows("n", "since")
    top = line.groupBy("mark").agg(F.max(F.struct("n", (-F.col("since")).alias("early"), "v")).alias("top"))
    marks = rows.select(F.col(mark).alias("mark")).distinct().join(top, "mark", "left")
    marks = R.Blocks.of(marks, [], [F.col("mark")], parts).running({"best": ("max", F.col("top"))}).rows("best")
    found = marks.where("mark > 0").select(F.col("mark").alias(mark), F.col("best.v").alias(best))
    return rows.join(found, mark, "left").select(*df.columns, F.col(best).alias(out))


def impute(df: DataFrame, columns: list[str] | None = None, strategy: str = "fill_constant", fill_values: dict[str, Any] | None = None, required: list[str] | None = None,
           field_config: dict[str, dict[str, Any]] | None = None, order: str | None = None, partition_by: list[str] | None = None, mode: str = "batch", strict: bool = False) -> DataFrame:
    """Fill or reject missing values of ``columns``.

    ``field_config`` gives single columns a strategy (and value) of their own. ``mode``: "batch"
    takes statistics over all rows, "online" over the rows seen at the last refresh. Required
    fields that are missing are errors under every strategy; a missing column counts as missing.
    """
    df = A.audited(df)
    columns = [c for c in df.columns if not c.startswith("_")] if columns is None else columns
    tests = [(gap(df, c) if c in df.columns else F.lit(True), A.item(STAGE, c, "required", F.lit(None))) for c in required or []]
    changes: dict[str, Column] = {}
    drop: list[str] = []
    for c in columns:
        own = (field_config or {}).get(c, {})
        how, kind = own.get("strategy", strategy), df.schema[c].dataType
        if how not in STRATEGIES:
            raise ValueError(f"unknown strategy {how}")
        missing, fill = gap(df, c), None
        if how == "reject":
            tests.append((missing, A.item(STAGE, c, "missing_value_no_fill", F.col(c))))
        elif how == "fill_constant":
            const = own.get("value", (fill_values or {}).get(c))
            fill = None if const is None else F.lit(const)
        elif how in ("fill_forward", "fill_backward"):
            if order is None:
                raise ValueError(f"{how} needs an order column")
            back = how == "fill_backward"
            if partition_by:
                w = Window.partitionBy(*partition_by).orderBy(F.col(order).desc() if back else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
                fill = F.last(value(df, c), ignorenulls=True).over(w)
            else:
                df = R.running(df, order, {f"_near_{c}": ("last", value(df, c))}, inclusive=False, backwards=back)
                fill = F.col(f"_near_{c}")
                drop.append(f"_near_{c}")
        elif mode == "online":
            seen = D.fresh(df, f"_seen_{c}")
            df = online(df, c, how, order, seen)
            fill = F.col(seen)
            drop.append(seen)
        else:
            stat = statistic(df, c, how, order)
            fill = None if stat is None else F.lit(stat)
        if fill is not None:
            changes[c] = F.when(missing, fill.cast(kind)).otherwise(F.col(c))
    return A.applied(df, A.failures(tests), changes, strict=strict).drop(*drop)


def stats(df: DataFrame, columns: list[str], done: DataFrame | None = None) -> DataFrame:
    """field, total_rows, missing: by one aggregation, in long form; with ``done``, what ``impute`` made of ``df``, also filled and rejected rows."""
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(gap(df, c)).alias(c) for c in columns])
    out = one.unpivot("total_rows", columns, "field", "missing").select("field", "total_rows", "missing")
    if done is None:
        return out
    left = done.agg(F.count_if(~F.col(A.VALID)).alias("rejected"), *[F.count_if(gap(done, c)).alias(c) for c in columns]).unpivot("rejected", columns, "field", "left")
    return out.join(F.broadcast(left), "field").select("field", "total_rows", "missing", (F.col("missing") - F.col("left")).alias("filled"), "rejected")
