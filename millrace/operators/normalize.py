"""Scaling of numbers: fit takes one aggregation over all rows, transform is column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ordered as D
from millrace.functions import orderstats
from millrace.functions import running as R
from millrace.operators import audit as A

STAGE = "normalize"
STRATEGIES = ("min_max", "z_score", "robust", "max_abs", "unit_vector", "log", "none")
FLOOR = 1e-8


@dataclass
class Normalizer:
    fields: list[str] | None = None
    strategy: str = "min_max"
    feature_range: tuple[float, float] = (0.0, 1.0)
    with_mean: bool = True
    with_std: bool = True
    clip: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")

    def fit(self, df: DataFrame, order: str | None = None) -> NormalizerModel:
        fields = self.fields or auto_fields(df, order)
        if self.strategy in ("unit_vector", "none") or not fields:
            return NormalizerModel(self, fields, {})
        aggs = []
        for f in fields:
            c = F.col(f).cast("double")
            aggs += [F.min(c).alias(f"{f}|min"), F.max(c).alias(f"{f}|max"), F.avg(c).alias(f"{f}|mean"), F.stddev_pop(c).alias(f"{f}|std")]
        row = df.agg(*aggs).first()
        stats = {f: {k: row[f"{f}|{k}"] for k in ("min", "max", "mean", "std")} for f in fields}
        if self.strategy == "robust":
            for f in fields:
                stats[f] |= quartiles(df, f)
        return NormalizerModel(self, fields, stats)


def quartiles(df: DataFrame, f: str) -> dict[str, float]:
    """median (two middle values averaged), q1 = sorted[n // 4], q3 = sorted[3n // 4]."""
    v, n = df.select(F.col(f).cast("double").alias("v")), F.col("_all")
    at = {"q1": F.floor(n / 4), "q3": F.floor(3 * n / 4), "m1": F.floor((n - 1) / 2), "m2": F.floor(n / 2)}
    got = orderstats.group_places(v, [], "v", at).first()
    if got is None or got.q1 is None:
        return {"median": None, "q1": None, "q3": None}
    return {"median": (got.m1 + got.m2) / 2, "q1": got.q1, "q3": got.q3}


def auto_fields(df: DataFrame, order: str | None = None, rows: int = 1000) -> list[str]:
    """Numeric columns with over two distinct values in the first 1000 rows (by ``order``): the limit is the feature."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")]
    head = (df.orderBy(order) if order else df).select(*numbers).limit(rows)
    row = head.agg(*[F.count_distinct(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if row[c] > 2]


@dataclass
class NormalizerModel:
    normalizer: Normalizer
    fields: list[str]
    stats: dict[str, dict[str, float]]

    def scaled(self, f: str) -> Column:
        n, s = self.normalizer, self.stats.get(f)
        x = F.col(f).cast("double")
        if n.strategy == "none" or s is None or s["min"] is None:
            return x
        if n.strategy == "min_max":
            lo, hi = n.feature_range
            span = (s["max"] - s["min"]) or 1.0
            v = (x - s["min"]) / span * (hi - lo) + lo
            return F.greatest(F.least(v, F.lit(float(hi))), F.lit(float(lo))) if n.clip else v
        if n.strategy == "z_score":
            v = x - s["mean"] if n.with_mean else x
            return v / max(s["std"], FLOOR) if n.with_std else v
        if n.strategy == "robust":
            return (x - s["median"]) / max(s["q3"] - s["q1"], FLOOR)
        if n.strategy == "max_abs":
            return x / (max(abs(s["min"]), abs(s["max"])) or 1.0)
        shift = abs(s["min"]) + 1 if s["min"] <= 0 else 0.0
        return F.when(x.isNull(), F.lit(None)).when(x + shift > 0, F.ln(x + shift)).otherwise(0.0)

    def transform(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """Unfitted fields pass unchanged. unit_vector: rows of norm zero are invalid."""
        df = A.audited(df)
        fields = [f for f in self.fields if f in df.columns]
        if self.normalizer.strategy == "unit_vector":
            norm = F.sqrt(sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) ** 2 for f in fields), F.lit(0.0)))
            tests = [(norm == 0, A.item(STAGE, ",".join(fields), "zero_norm", norm))]
            new = {f: F.when(norm != 0, F.col(f).cast("double") / norm).otherwise(F.col(f).cast("double")) for f in fields}
        else:
            tests, new = [], {f: self.scaled(f) for f in fields}
        live = F.col(A.VALID) if strict else F.lit(True)
        out = df.withColumn("_new", F.when(live, A.failures(tests)).otherwise(F.array().cast(A.ITEM)))
        return out.withColumns(new | {A.ERRORS: F.concat(A.ERRORS, "_new"), A.VALID: F.col(A.VALID) & (F.size("_new") == 0)}).drop("_new")


def online(df: DataFrame, f: str, order: str, strategy: str = "z_score", refresh: int = 1000, out: str | None = None, feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``out`` (else ``f`` itself) scaled by what had been seen at the last multiple of ``refresh`` rows in ``order``; before it, unchanged.

    Sums, extremes and quartiles run over blocks of rows; the values at a mark are carried to the rows behind it.
    """
    if strategy not in ("z_score", "min_max", "max_abs", "log", "robust", "none"):
        raise ValueError(f"no online form: {strategy}")
    x = F.col(f).cast("double")
    names = df.columns
    made = {k: D.fresh(df, f"_{k}") for k in ("row", "s", "q", "n", "lo", "hi", "median", "q1", "q3")}
    kept = {"z_score": "sqn", "min_max": ["lo", "hi"], "max_abs": ["lo", "hi"], "log": ["lo"], "robust": ["median", "q1", "q3"], "none": []}[strategy]
    kinds = {"s": ("sum", x), "q": ("sum", x * x), "n": ("count", x), "lo": ("min", x), "hi": ("max", x)}
    if strategy == "robust":
        df = orderstats.running_statistics(df, [], [F.col(order)], x, {made[k]: k for k in kept}, parts=parts)
        kinds = {k: ("last", F.col(made[k])) for k in kept}
    rows = R.Blocks.of(df, [], [F.col(order)], parts).running({made["row"]: ("count", F.lit(1))} | {made[k]: kinds[k] for k in kept})
    at_mark = F.col(made["row"]) % refresh == 0
    rows = rows.running({made[k]: ("last", F.when(at_mark, F.col(made[k]))) for k in kept})
    df = rows.rows(*[made[k] for k in kept])
    v = {k: F.col(made[k]) for k in kept}
    if strategy == "z_score":
        mean = v["s"] / v["n"]
        scaled = (x - mean) / F.greatest(F.sqrt(F.greatest(v["q"] / v["n"] - mean * mean, F.lit(0.0))), F.lit(FLOOR))
    elif strategy == "min_max":
        low, high = map(float, feature_range)
        span = F.when(v["hi"] != v["lo"], v["hi"] - v["lo"]).otherwise(1.0)
        scaled = (x - v["lo"]) / span * (high - low) + low
        scaled = F.when(x.isNotNull(), F.greatest(F.least(scaled, F.lit(high)), F.lit(low))) if clip else scaled
    elif strategy == "max_abs":
        most = F.greatest(F.abs(v["lo"]), F.abs(v["hi"]))
        scaled = x / F.when(most > 0, most).otherwise(1.0)
    elif strategy == "log":
        shifted = x + F.when(v["lo"] <= 0, F.abs(v["lo"]) + 1).otherwise(0.0)
        scaled = F.when(shifted > 0, F.ln(shifted)).when(shifted <= 0, 0.0)
    elif strategy == "robust":
        scaled = (x - v["median"]) / F.greatest(v["q3"] - v["q1"], F.lit(FLOOR))
    else:
        scaled = x
    fitted = v[kept[0]].isNotNull() if kept else F.lit(True)
    return df.withColumn(out or f, F.when(fitted, scaled).otherwise(x)).select(*names, *([out] if out and out not in names else []))


def online_z(df: DataFrame, f: str, order: str, refresh: int = 1000) -> DataFrame:
    """z-scores by ``online``, in a column of their own."""
    return online(df, f, order, "z_score", refresh, f"{f}_z")


def unit_arrays(c: Column) -> Column:
    """An array over its L2 norm; null for norm zero."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm))
