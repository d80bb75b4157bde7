"""Duplicate detection by key columns (or whole rows), in the order of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import ordered as O
from millrace.functions.scalars import group_key
from millrace.operators import audit as A
from millrace.session import drop_written, written

STAGE = "duplicates"
STRATEGIES = ("reject", "keep_first", "keep_last", "mark")
# The field and error that a repeated row is reported under.
FIELD, ERROR = "_duplicate", "duplicate_row"
#: The documented strategy that has no error of its own elsewhere.
REPLACED = "replaced_by_later"


def copies(df: DataFrame, order: str, keys: list[str], row: str, last: bool) -> DataFrame:
    """row, seen: the rows that repeat a key, with the order value of the row that stays (the first, or the last).

    Rows carry 128 bits that name their key's values (null differs from every value, and from null elsewhere), never the
    values. Only keys that occur again are looked up: the hot ones by broadcast, the others by shuffle.
    """
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    narrow = df.select(F.col(row).alias("row"), F.struct(F.col(order).alias("at"), F.col(row).alias("row")).alias("place"), *[F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (0, 1)])
    found = narrow.groupBy("h0", "h1").agg((F.max if last else F.min)("place").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = written(found, "duplicate-keys")
    again = O.spread(narrow, found, ["h0", "h1"], "n").where(F.col("row") != F.col("stays.row"))
    out = written(again.select("row", F.col("stays.at").alias("seen")), "duplicate-rows")
    drop_written(found)
    return out


def dedup(df: DataFrame, order: str, keys: list[str] | None = None, strategy: str = "reject", strict: bool = False) -> DataFrame:
    """reject, keep_first, keep_last: one row of each key is valid. mark: all are, duplicates with _is_duplicate, _duplicate_key, _first_seen_index.

    Keys compare null-safely by value; without ``keys`` all columns but ``order`` are the key. Values of ``order`` may repeat and be null: nulls come first, and
    rows of one value in the order in which they are stored, so exactly one row of each key stays. Without a repeated key nothing is joined but an empty table.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    df = A.audited(df)
    names = df.columns
    keys = keys or sorted(c for c in names if not c.startswith("_") and c != order)
    row, seen, at = O.fresh(df, "_row"), O.fresh(df, "_seen"), O.fresh(df, "_at")
    stored = O.numbered(df, row, "duplicates")
    again = copies(stored, order, keys, row, strategy == "keep_last").select(F.col("row").alias(at), F.struct("seen").alias(seen))
    joined = stored.join(again, F.col(row) == F.col(at), "left")
    repeated = F.col(seen).isNotNull()
    if strategy == "mark":
        out = joined.withColumns({"_is_duplicate": repeated, "_duplicate_key": F.when(repeated, group_key(keys)), "_first_seen_index": F.col(seen)["seen"]})
        return out.drop(row, seen, at)
    error = REPLACED if strategy == "keep_last" else ERROR
    return A.applied(joined, A.failures([(repeated, A.item(STAGE, FIELD, error, group_key(keys)))]), {}, strict=strict).drop(row, seen, at)


def stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """unique_keys, total_duplicates, duplicate_groups."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("unique_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("total_duplicates"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
