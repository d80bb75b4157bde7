"""Row audit: errors and warnings travel as columns; a row is valid while it has no errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS, WARNINGS, VALID = "_errors", "_warnings", "_valid"
ITEM = "array<struct<stage:string,field:string,error:string,value:string>>"


def audited(df: DataFrame) -> DataFrame:
    for c in (ERRORS, WARNINGS):
        if c not in df.columns:
            df = df.withColumn(c, F.array().cast(ITEM))
    return df if VALID in df.columns else df.withColumn(VALID, F.lit(True))


def item(stage: str, field: str, error: str, value: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(field).alias("field"), F.lit(error).alias("error"), value.cast("string").alias("value"))


def failures(tests: list[tuple[Column, Column]]) -> Column:
    """The items whose test holds: tests are (failed, item)."""
    if not tests:
        return F.array().cast(ITEM)
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), i) for t, i in tests]), lambda x: x.isNotNull())


def applied(df: DataFrame, errors: Column, changes: dict[str, Column], warnings: Column | None = None, strict: bool = False) -> DataFrame:
    """One stage: new values where it succeeds, the values before it where it fails; errors add up.

    With ``strict`` a row that has failed before passes through this stage untouched.
    """
    df = audited(df)
    live = F.col(VALID) if strict else F.lit(True)
    df = df.withColumn("_new", F.when(live, errors).otherwise(F.array().cast(ITEM)))
    fine = live & (F.size("_new") == 0)
    cols = {c: F.when(fine, v).otherwise(F.col(c)) if c in df.columns else F.when(fine, v) for c, v in changes.items()}
    cols[ERRORS] = F.concat(F.col(ERRORS), F.col("_new"))
    if warnings is not None:
        cols[WARNINGS] = F.when(live, F.concat(F.col(WARNINGS), warnings)).otherwise(F.col(WARNINGS))
    cols[VALID] = F.col(VALID) & (F.size("_new") == 0)
    return df.withColumns(cols).drop("_new")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without audit columns, and rejected rows with them."""
    return df.where(VALID).drop(ERRORS, WARNINGS, VALID), df.where(~F.col(VALID))


def ledger(df: DataFrame, key: str) -> DataFrame:
    """key, stage, field, error, value: a row for each error of each rejected row."""
    return df.where(~F.col(VALID)).select(key, F.explode(ERRORS).alias("e")).select(key, "e.*")


def stats(df: DataFrame) -> DataFrame:
    """total_rows, valid_rows, rejected_rows, success_rate."""
    n, ok = F.count(F.lit(1)), F.count_if(VALID)
    return df.agg(n.alias("total_rows"), ok.alias("valid_rows"), (n - ok).alias("rejected_rows"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("success_rate"))
