"""Conversions of loosely typed values: null where a value doesn't convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted words and date layouts, in the order in which they are tried.
TRUE_WORDS = ["true", "1", "yes", "y", "t", "on"]
FALSE_WORDS = ["false", "0", "no", "n", "f", "off"]
DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%SZ", "%d/%m/%Y", "%m/%d/%Y"]
TYPE_NAMES = {
    "str": "string", "string": "string", "int": "int", "integer": "int", "float": "float", "double": "float",
    "bool": "bool", "boolean": "bool", "datetime": "datetime", "date": "datetime",
}
NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?$"
_PARTS = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "h", "%z": "xx", "%j": "D"}


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_missing(c: Column, kind: T.DataType | None = None) -> Column:
    """Null, blank text or NaN."""
    out = c.isNull()
    if kind is None or is_text(kind):
        out = out | (F.trim(F.regexp_replace(c.cast("string"), r"\s", " ")) == "")
    if kind is None:
        out = out | (F.lower(c.cast("string")) == "nan")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = out | F.isnan(c)
    return F.coalesce(out, F.lit(True))


def to_float(c: Column, kind: T.DataType = T.StringType()) -> Column:
    if not is_text(kind):
        return c.cast("double") if is_number(kind) else c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else F.lit(None).cast("double")
    s = F.trim(c)
    special = F.regexp_extract(F.lower(s), r"^([+-]?)(inf|infinity|nan)$", 0)
    return F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")).when(special != "", special.try_cast("double"))


def to_int(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Truncates towards zero; infinite and not-a-number values don't convert."""
    v = to_float(c, kind)
    return F.when(~F.isnan(v) & (F.abs(v) < 9.2e18), v).cast("bigint")


def to_bool(c: Column, kind: T.DataType = T.StringType(), true_words: list[str] | None = None, false_words: list[str] | None = None) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if is_number(kind):
        return c != 0
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*(true_words or TRUE_WORDS)), True).when(s.isin(*(false_words or FALSE_WORDS)), False)


def spark_format(strptime: str) -> str:
    """A strptime layout as Spark's; one-letter parts accept unpadded numbers."""
    out, i, quoted = "", 0, ""
    while i < len(strptime):
        part = strptime[i : i + 2]
        if part in _PARTS:
            out += (f"'{quoted}'" if quoted else "") + _PARTS[part]
            quoted, i = "", i + 2
        elif strptime[i].isalpha():
            quoted, i = quoted + strptime[i], i + 1
        else:
            out += (f"'{quoted}'" if quoted else "") + strptime[i]
            quoted, i = "", i + 1
    return out + (f"'{quoted}'" if quoted else "")


def to_datetime(c: Column, kind: T.DataType = T.StringType(), formats: list[str] | None = None) -> Column:
    """The first layout that fits; numbers are unix seconds."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if is_number(kind):
        return F.timestamp_micros((c.cast("double") * 1_000_000).cast("bigint"))
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(spark_format(f))) for f in formats or DATE_FORMATS])


def convert(c: Column, kind: T.DataType, target: str, **options) -> Column:
    target = TYPE_NAMES.get(target, "string")
    if target == "int":
        return to_int(c, kind)
    if target == "float":
        return to_float(c, kind)
    if target == "bool":
        return to_bool(c, kind, options.get("true_words"), options.get("false_words"))
    if target == "datetime":
        return to_datetime(c, kind, options.get("formats"))
    return F.when(c, "True").otherwise(F.when(c.isNotNull(), "False")) if isinstance(kind, T.BooleanType) else c.cast("string")


#: What every layout of DATE_FORMATS looks like; a cheap test before the layouts are tried.
DATE_LIKE = r"^\s*[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}(?:$|[ T\s])"
WHOLE = r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"


def inferred(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """For each text column the first of int, float, bool, datetime that all its values convert to, else string.

    One aggregation over all rows; layouts of dates are tried only on columns whose values all look like dates.
    A column without values stays string.
    """
    text = [c for c in columns if is_text(df.schema[c].dataType)]
    if not text:
        return {}
    aggs = []
    for c in text:
        missing = is_missing(F.col(c), T.StringType())
        aggs.append(F.count_if(~missing).alias(f"{c}|n"))
        aggs += [F.count_if(~missing & F.coalesce(F.col(c).rlike(p), F.lit(False))).alias(f"{c}|{t}") for t, p in (("int", WHOLE), ("dated", DATE_LIKE))]
        aggs += [F.count_if(~missing & convert(F.col(c), T.StringType(), t).isNotNull()).alias(f"{c}|{t}") for t in ("float", "bool")]
    row = df.agg(*aggs).first()
    out = {c: next((t for t in ("int", "float", "bool") if row[f"{c}|n"] and row[f"{c}|{t}"] == row[f"{c}|n"]), "string") for c in text}
    dated = [c for c in text if out[c] == "string" and row[f"{c}|n"] and row[f"{c}|dated"] == row[f"{c}|n"]]
    if dated:
        fine = df.agg(*[F.count_if(~is_missing(F.col(c), T.StringType()) & convert(F.col(c), T.StringType(), "datetime").isNotNull()).alias(c) for c in dated]).first()
        out |= {c: "datetime" for c in dated if fine[c] == row[f"{c}|n"]}
    return out


def inferred_value(c: Column) -> Column:
    """Each text value by itself: type (int, float, bool, datetime or string; null if missing) and its value in the field of that type."""
    none = is_missing(c, T.StringType())
    whole, number, flag = c.rlike(WHOLE), to_float(c), to_bool(c)
    date = F.when(c.rlike(DATE_LIKE), to_datetime(c))
    kind = F.when(none, None).when(whole, "int").when(number.isNotNull(), "float").when(flag.isNotNull(), "bool").when(date.isNotNull(), "datetime").otherwise("string")
    return F.struct(
        kind.alias("type"), F.when(kind == "int", to_int(c)).alias("int"), F.when(kind == "float", number).alias("float"), F.when(kind == "bool", flag).alias("bool"),
        F.when(kind == "datetime", date).alias("datetime"), F.when(kind == "string", c).alias("string"),
    )
