"""Scalar functions: dates, texts, maps, JSON, validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(c: Column) -> Column:
    return c.cast("int")


def month_end(c: Column, exact: bool = False) -> Column:
    """By default day 28, as the configured feature has always meant; ``exact`` takes the last day."""
    return _flag(F.last_day(c) == F.to_date(c)) if exact else _flag(F.dayofmonth(c) == 28)


DATE_PARTS = {
    "hour": F.hour, "day": F.dayofmonth, "month": F.month, "year": F.year, "weekday": F.weekday, "is_weekend": lambda c: _flag(F.weekday(c) >= 5),
    "quarter": F.quarter, "day_of_year": F.dayofyear, "week_of_year": F.weekofyear, "is_month_start": lambda c: _flag(F.dayofmonth(c) == 1), "is_month_end": month_end,
}


def _left(c: Column, outside: str) -> Column:
    """Characters that remain when those matching ``outside`` are taken away."""
    return F.length(F.regexp_replace(c, outside, ""))


TEXT_PARTS = {
    "length": F.length,
    "word_count": lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")),
    "char_count": lambda c: F.length(F.replace(c, F.lit(" "), F.lit(""))),
    "uppercase_count": lambda c: _left(c, r"[^\p{Lu}]"),
    "digit_count": lambda c: _left(c, r"[^\p{Nd}]"),
    "special_char_count": lambda c: _left(c, r"[\p{L}\p{N}\s]"),
}


def truncated(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substr(c, F.lit(1), F.lit(max(0, most - len(suffix)))), F.lit(suffix))).otherwise(c)


def json_path(c: Column, path: list[str], default: Column | None = None) -> Column:
    """A nested entry of JSON text, or the default."""
    got = F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))
    return got if default is None else F.coalesce(got, default)


def merged(left: Column, right: Column) -> Column:
    """A shallow merge of two maps; the right one wins."""
    only = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(only, right)


def group_key(columns: list[str]) -> Column:
    """For display: a=1|b=2, NULL for null, _global_ without columns. Grouping itself is by the columns."""
    if not columns:
        return F.lit("_global_")
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in columns])


VALIDATORS = {
    "required": lambda c: c.isNotNull() & (F.trim(c.cast("string")) != ""),
    "min_length": lambda c, n: F.length(c) >= n,
    "max_length": lambda c, n: F.length(c) <= n,
    "range": lambda c, lo, hi: (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c <= hi),
    "one_of": lambda c, values: c.isin(*values),
    "pattern": lambda c, p: c.rlike(f"^(?:{p})"),
    "email": lambda c: c.rlike(r"^[^@]+@[^@]+\.[^@]+$"),
    "url": lambda c: c.rlike(r"^https?://.+"),
}


def validator(name: str, c: Column, *args) -> Column:
    """One of VALIDATORS; null fails."""
    return F.coalesce(VALIDATORS[name](c, *args), F.lit(False))
