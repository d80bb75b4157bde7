"""Rows in order, in blocks: the ground of everything that depends on order and must not meet in one task.

``numbered`` stores rows with a number of their own, so that equal rows are still told apart. ``placed``
deals rows by range of (group, order): each block is a stretch of neighbouring rows, a group may
span any number of blocks, and what a block needs of earlier ones is carried in a table with one row
for each group and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Keys with at least so many rows may be hot; at most so many keys can hold more than their share of all rows.
HOT_ROWS, HOT_KEYS = 1000, 50_000
#: Rows of a block at most, as a power of two (33 bits of ``pos`` are the row's place in its range).
BLOCK_BITS = 16


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def marks(groups: list[Column], *names: str) -> list[Column]:
    """128 bits that name a group, null groups among them, in two columns."""
    parts = [c for g in groups for c in (g.isNull(), g)]
    return [F.xxhash64(F.lit(seed), *parts).alias(n) for seed, n in enumerate(names)]


def numbered(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df``, stored, with a number for each row: rows read later are the ones numbered here."""
    return written(df.withColumn(number, F.monotonically_increasing_id()), name)


def spread(rows: DataFrame, table: DataFrame, on: list[str], copies: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each of its keys; ``copies``: how many of ``rows`` have it) on equal keys.

    Keys that hold more than a 50,000th of these rows, hence fewer than 50,000 of them, are broadcast,
    so that no task gathers the copies of one key; the others are shuffled.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = table.where(F.col(copies) > bar), table.where(F.col(copies) <= bar)
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(rest, on))


def placed(df: DataFrame, by: list[str], pos: str, name: str, parts: int | None = None) -> DataFrame:
    """``df``, stored in the order of ``by``, with ``pos``, which rises in that order over all rows; rows of equal values get one order.

    The upper bits of ``pos`` (``block_of``) name the range that holds the row, and its stretch of ``2 ** BLOCK_BITS`` rows.
    """
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return written(ranged.sortWithinPartitions(*by).withColumn(pos, F.monotonically_increasing_id()), name)


def block_of(pos: str) -> Column:
    """However few ranges the rows were dealt to, a block stays within what one task may hold."""
    return F.shiftright(pos, BLOCK_BITS)


def earlier(groups: list[str], block: str):
    """Over a table with a row for each group and block: the group's blocks before this one."""
    return Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
