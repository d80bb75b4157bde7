"""Type conversion by mapping, or inferred for a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.operators import audit as A

STAGE = "convert"


def convert(df: DataFrame, mapping: dict[str, str] | None = None, auto_infer: bool = False, fail_on_error: bool = False, strict: bool = False, **options) -> DataFrame:
    """Convert columns; what doesn't convert becomes null with an error (or raises, with ``fail_on_error``). Null stays null.

    A column that is rejected keeps its old type's text for reporting; converted columns take the new type for all rows.
    """
    df = A.audited(df)
    mapping = {c: t for c, t in (mapping or {}).items() if c in df.columns}
    auto = [c for c, t in mapping.items() if t == "auto"]
    if auto_infer:
        auto += [c for c in df.columns if not c.startswith("_") and c not in mapping]
    mapping = {c: t for c, t in mapping.items() if t != "auto"} | {c: t for c, t in K.inferred(df, auto).items() if t != "string"}
    tests, new = [], {}
    for c, target in mapping.items():
        kind = df.schema[c].dataType
        v = K.convert(F.col(c), kind, target, **options)
        failed = F.col(c).isNotNull() & v.isNull()
        if fail_on_error:
            v = F.when(failed, F.raise_error(F.concat(F.lit(f"{c}: not {target}: "), F.col(c).cast("string"))).cast("string").try_cast(df.select(v.alias("v")).schema["v"].dataType)).otherwise(v)
        tests.append((failed, A.item(STAGE, c, f"not_{K.TYPE_NAMES.get(target, 'string')}", F.col(c))))
        new[c] = v
    live = F.col(A.VALID) if strict else F.lit(True)
    df = df.withColumn("_new", F.when(live, A.failures(tests)).otherwise(F.array().cast(A.ITEM)))
    cols = new | {A.ERRORS: F.concat(A.ERRORS, "_new"), A.VALID: F.col(A.VALID) & (F.size("_new") == 0)}
    return df.withColumns(cols).drop("_new")


def stats(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """field, type, converted, errors: in long form, by one aggregation."""
    aggs = []
    for c, target in mapping.items():
        v = K.convert(F.col(c), df.schema[c].dataType, target)
        aggs += [F.count_if(v.isNotNull()).alias(f"{c}|ok"), F.count_if(F.col(c).isNotNull() & v.isNull()).alias(f"{c}|bad")]
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(t).alias("type"), F.col(f"`{c}|ok`").alias("converted"), F.col(f"`{c}|bad`").alias("errors")) for c, t in mapping.items()])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
