"""Statistics that come with the pass that writes the rows: metrics observed where rows go by, read when the write is over.

``Observed.df`` is used in place of the frame; after its first action (a write, usually) ``table()`` has the numbers, without a scan of its own.
On streams the same metrics arrive with each batch's progress (``millrace.streaming.metrics.MetricsTable``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.functions import ordered as D
from millrace.operators import audit as A
from millrace.operators import convert, missing


@dataclass(frozen=True)
class Observed:
    df: DataFrame
    observation: Observation
    columns: tuple[str, ...]

    def numbers(self) -> dict[str, int]:
        """Of the first action on ``df``; waits for it."""
        return {k: v or 0 for k, v in self.observation.get.items()}

    def table(self) -> DataFrame:
        """The metrics ``<row>|<column>`` as rows with the columns."""
        rows: dict[str, dict[str, int]] = {}
        for k, v in self.numbers().items():
            name, metric = k.rsplit("|", 1)
            rows.setdefault(name, {})[metric] = v
        schema = f"{self.columns[0]} string, " + ", ".join(f"{c} bigint" for c in self.columns[1:])
        return self.df.sparkSession.createDataFrame([(n, *[m.get(c) for c in self.columns[1:]]) for n, m in rows.items()], schema)


def watched(df: DataFrame, metrics: dict[str, Column], columns: tuple[str, ...]) -> Observed:
    """``df`` with these aggregates observed as it goes by."""
    seen = Observation(f"millrace-{uuid.uuid4().hex}")
    return Observed(df.observe(seen, *[v.alias(k) for k, v in metrics.items()]), seen, columns)


def imputed(df: DataFrame, columns: list[str], **options) -> Observed:
    """``missing.impute``, with field, total_rows, missing, filled, rejected."""
    was = {c: D.fresh(df, f"_was_{c}") for c in columns}
    out = missing.impute(df.withColumns({was[c]: missing.gap(df, c) for c in columns}), columns, **options)
    metrics = {}
    for c in columns:
        metrics |= {f"{c}|total_rows": F.count(F.lit(1)), f"{c}|missing": F.count_if(was[c]), f"{c}|filled": F.count_if(F.col(was[c]) & ~missing.gap(out, c)), f"{c}|rejected": F.count_if(~F.col(A.VALID))}
    seen = watched(out, metrics, ("field", "total_rows", "missing", "filled", "rejected"))
    return Observed(seen.df.drop(*was.values()), seen.observation, seen.columns)


def converted(df: DataFrame, mapping: dict[str, str], **options) -> Observed:
    """``convert.convert``, with field, converted, errors."""
    made = {c: K.convert(F.col(c), df.schema[c].dataType, t) for c, t in mapping.items()}
    metrics = {}
    for c, v in made.items():
        metrics |= {f"{c}|converted": F.count_if(v.isNotNull()), f"{c}|errors": F.count_if(F.col(c).isNotNull() & v.isNull())}
    before = watched(df, metrics, ("field", "converted", "errors"))
    return Observed(convert.convert(before.df, mapping, **options), before.observation, before.columns)


def audited(df: DataFrame, stages: list[str]) -> Observed:
    """Rows with audit columns, with stage, rows, failed: of each stage, and of all as ``total``."""
    failed = lambda s: F.count_if(F.exists(A.ERRORS, lambda e: e["stage"] == s))
    metrics = {"total|rows": F.count(F.lit(1)), "total|failed": F.count_if(~F.col(A.VALID))}
    for s in stages:
        metrics |= {f"{s}|rows": F.count(F.lit(1)), f"{s}|failed": failed(s)}
    return watched(A.audited(df), metrics, ("stage", "rows", "failed"))
