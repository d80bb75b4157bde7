"""Small tests inside a row: a bit table of 64-bit hashes, for finding the few positions worth a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bit_table(hashes: list[int], least_bits: int = 12, most_bits: int = 24) -> tuple[Column, int]:
    """A literal array of 64-bit words with the bit of each hash set; and its number of bits.

    It has at least 64 bits for each hash (up to 2 MB), so it passes few others. What it
    passes is joined exactly afterwards: its size touches cost, never results.
    """
    n = least_bits
    while (1 << n) < 64 * len(hashes) and n < most_bits:
        n += 1
    cells = [0] * (1 << (n - 6))
    for h in hashes:
        at = h & ((1 << n) - 1)
        cells[at >> 6] |= 1 << (at & 63)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in cells]
    return F.lit(signed).cast("array<bigint>"), 1 << n


def may_hold(bits: tuple[Column, int], h: Column) -> Column:
    cells, n = bits
    at = h.bitwiseAND(F.lit(n - 1))
    return F.getbit(F.get(cells, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def bit_table_of(df: DataFrame, h: Column, least_bits: int = 12, most_bits: int = 24) -> tuple[Column, int]:
    """The same of a column of hashes: cells are combined by the executors, so at most 2 MB reach the driver, however many hashes."""
    hashes = df.select(h.alias("h"))
    count, n = hashes.agg(F.approx_count_distinct("h")).first()[0], least_bits
    while (1 << n) < 64 * count and n < most_bits:
        n += 1
    at = F.col("h").bitwiseAND(F.lit((1 << n) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    cells = [0] * (1 << (n - 6))
    for r in hashes.groupBy(F.shiftright(at, 6).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).collect():
        cells[r.cell] = r.bits
    return F.lit(cells).cast("array<bigint>"), 1 << n


def hashes_of(df: DataFrame, h: Column) -> list[int]:
    """The distinct hashes on the driver: for tables of terms whose number the caller has checked."""
    return [r.h for r in df.select(h.alias("h")).distinct().collect()]
