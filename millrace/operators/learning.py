"""Online models: learned as rows go by, tested on each row before it is learned, switched by recent accuracy; drift records.

A naive Bayes model of two classes is sums: of rows, values and squares for each class. Running sums over blocks give the model of every refresh
mark, and column expressions its prediction for the rows behind the mark, so nothing is learned in one task or by one row after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ordered as D
from millrace.functions import running as R
from millrace.session import written

#: Variances of a class are at least so large.
LEAST_VARIANCE = 1e-9


def prequential(df: DataFrame, order: str, actual: str, predicted: str, groups: list[str] | None = None, last: int = 1000) -> DataFrame:
    """``df`` with accuracy and error over the last ``last`` rows of its group (a model, a stream)."""
    hit = F.col(actual).eqNullSafe(F.col(predicted)).cast("double")
    made = lambda w: {"accuracy": F.avg(hit).over(w), "sample_count": F.count(F.lit(1)).over(w)}
    return R.last_rows(df, [F.col(g) for g in groups or []], [F.col(order)], last, made).withColumn("window_size", F.lit(last))


def drift(df: DataFrame, time: str, value: str, size: str, threshold: float, groups: list[str] | None = None) -> DataFrame:
    """One record for each window: how far its mean lies from the window before, in standard deviations of that one."""
    per = df.groupBy(F.window(time, size).alias("w"), *(groups or [])).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    order = Window.partitionBy(*(groups or [])).orderBy("w.start")
    score = F.abs(F.col("mean") - F.lag("mean").over(order)) / F.greatest(F.lag("sd").over(order), F.lit(1e-8))
    out = per.withColumn("drift_score", F.coalesce(score, F.lit(0.0)))
    return out.select(F.col("w.end").alias("timestamp"), *(groups or []), F.lit("mean_shift").alias("detector"), "drift_score", F.lit(threshold).alias("threshold"), (F.col("drift_score") > threshold).alias("is_drift"))


def _likelihood(x: Column, n: Column, s: Column, q: Column) -> Column:
    """Log density of a value under a normal distribution of these sums (less the constant)."""
    mean = s / n
    var = F.greatest(q / n - mean * mean, F.lit(LEAST_VARIANCE))
    return -0.5 * F.ln(var) - (x - mean) * (x - mean) / (2 * var)


def online_bayes(df: DataFrame, order: str, label: str, features: list[str], out: str = "predicted", refresh: int = 1000, recent: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the class (boolean ``label``) that a naive Bayes model of the rows up to the last refresh mark before a row expects of it.

    ``recent``: only the rows of so many marks count, so that the model forgets. Null features and labels don't count in the sums, and a null
    feature tells nothing; before the first mark, and while a class has no rows, the expected class is the one that has (false without any).
    """
    y = F.col(label).cast("boolean")
    row, mark = D.fresh(df, "_row"), D.fresh(df, "_mark")
    measures = {row: ("count", F.lit(1))}
    for c, is_c in ((0, ~y), (1, y)):
        measures[f"_n{c}"] = ("sum", F.when(is_c, 1.0))
        for i, f in enumerate(features):
            x = F.when(is_c, F.col(f).cast("double"))
            measures |= {f"_k{c}_{i}": ("sum", F.when(x.isNotNull(), 1.0)), f"_s{c}_{i}": ("sum", x), f"_q{c}_{i}": ("sum", x * x)}
    sums = [m for m in measures if m != row]
    rows = R.Blocks.of(df, [], [F.col(order)], parts).running(measures).rows(row, *sums)
    rows = written(rows, "online-bayes")
    marks = rows.where(F.col(row) % refresh == 0).select((F.col(row) / refresh).cast("long").alias(mark), *sums)
    if recent is not None:
        old = marks.select((F.col(mark) + recent).alias("_then"), *[F.col(c).alias(f"_o{c}") for c in sums])
        marks = marks.join(old, F.col(mark) == F.col("_then"), "left").select(mark, *[(F.col(c) - F.coalesce(f"_o{c}", F.lit(0.0))).alias(c) for c in sums])
    found = rows.drop(*sums).withColumn(mark, F.floor((F.col(row) - 1) / refresh)).join(marks, mark, "left")
    n0, n1 = F.coalesce("_n0", F.lit(0.0)), F.coalesce("_n1", F.lit(0.0))
    odds = F.ln(n1) - F.ln(n0)
    for i, f in enumerate(features):
        told = [_likelihood(F.col(f).cast("double"), *[F.col(f"_{k}{c}_{i}") for k in "ksq"]) for c in (1, 0)]
        odds = odds + F.coalesce(F.when((F.col(f"_k0_{i}") > 0) & (F.col(f"_k1_{i}") > 0), told[0] - told[1]), F.lit(0.0))
    return found.select(*df.columns, F.when((n0 > 0) & (n1 > 0), odds > 0).otherwise(n1 > n0).alias(out))


def switched(df: DataFrame, order: str, actual: str, predictions: list[str], last: int = 500, groups: list[str] | None = None) -> DataFrame:
    """``df`` with model (the prediction that was right most often over the ``last`` rows before this one; ties: the first named) and expected (what it says here)."""
    names = [D.fresh(df, f"_right{i}") for i in range(len(predictions))]
    hit = lambda p: F.col(actual).eqNullSafe(F.col(p)).cast("int")
    made = lambda w: {n: F.sum(hit(p)).over(w) - hit(p) for n, p in zip(names, predictions, strict=True)}
    out = R.last_rows(df, [F.col(g) for g in groups or []], [F.col(order)], last + 1, made)
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("right"), F.lit(-i).alias("place")) for i, n in enumerate(names)]))["place"]
    model = F.element_at(F.array(*[F.lit(p) for p in predictions]), 1 - best)
    expected = F.element_at(F.array(*[F.col(p) for p in predictions]), 1 - best)
    return out.withColumns({"model": model, "expected": expected}).drop(*names)
