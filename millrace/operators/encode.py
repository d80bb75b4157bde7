"""Categorical encoding: fit counts categories over all rows, transform looks codes up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import audit as A

STAGE = "encode"
STRATEGIES = ("label", "one_hot", "ordinal", "binary", "frequency", "target")
#: Categories up to which codes become a literal map in the plan; beyond it they are joined.
MOST_INLINE = 1000


@dataclass
class Encoder:
    """Categories are values as text (null: "NULL"), most frequent first, ties by first appearance, the first ``max_categories``."""

    fields: list[str]
    strategy: str = "label"
    ordinal_mapping: dict[str, list[str]] = field(default_factory=dict)
    handle_unknown: str = "ignore"
    unknown_value: int = -1
    drop_first: bool = False
    max_categories: int = 100
    keep_original: bool = False
    target: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")

    def fit(self, df: DataFrame, order: str) -> EncoderModel:
        """One aggregation for each field; at most ``max_categories`` rows of each reach the driver."""
        found, totals = {}, {}
        for f in self.fields:
            key = F.coalesce(F.col(f).cast("string"), F.lit("NULL")).alias("category")
            y = [F.avg(self.target).alias("mean")] if self.target else []
            counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), *y)
            totals[f] = counts.agg(F.sum("n")).first()[0] or 0
            found[f] = counts.orderBy(F.desc("n"), "first").limit(self.max_categories).collect()
        return EncoderModel(self, {f: [r.category for r in rows] for f, rows in found.items()}, {f: {r.category: r.n for r in rows} for f, rows in found.items()}, totals, {f: {r.category: r["mean"] for r in rows} for f, rows in found.items()} if self.target else {})


def lookup(c: Column, codes: dict) -> Column:
    if not codes:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


@dataclass
class EncoderModel:
    encoder: Encoder
    categories: dict[str, list[str]]
    counts: dict[str, dict[str, int]]
    totals: dict[str, int]
    means: dict[str, dict[str, float]]

    def index(self, df: DataFrame, f: str, order: list[str]) -> tuple[DataFrame, Column]:
        """The 0-based code of a field's category: inline for few, by a broadcast join of its bounded table for more."""
        key = F.coalesce(F.col(f).cast("string"), F.lit("NULL"))
        codes = {c: i for i, c in enumerate(order)}
        if len(codes) <= MOST_INLINE:
            return df, lookup(key, codes).cast("int")
        table = df.sparkSession.createDataFrame(list(codes.items()), f"_k_{f} string, _c_{f} int")
        return df.join(F.broadcast(table), key == F.col(f"_k_{f}"), "left").drop(f"_k_{f}"), F.col(f"_c_{f}")

    def transform(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """Unknown categories: ignore makes the row invalid, error raises, use_encoded_value gives the unknown value (0 in bits)."""
        e = self.encoder
        df = A.audited(df)
        tests, changes, drop = [], {}, []
        for f in e.fields:
            cats = self.categories[f]
            if e.strategy == "ordinal" and f in e.ordinal_mapping:
                cats = [str(c) for c in e.ordinal_mapping[f]]
            key = F.coalesce(F.col(f).cast("string"), F.lit("NULL"))
            if e.strategy in ("frequency", "target"):
                if e.strategy == "target" and self.means:
                    changes[f] = lookup(key, self.means[f]).cast("double")
                else:
                    changes[f] = F.coalesce(lookup(key, self.counts[f]).cast("double") / F.lit(float(self.totals[f] or 1)), F.lit(0.0))
                continue
            df, code = self.index(df, f, cats)
            unknown = code.isNull()
            if e.handle_unknown == "error":
                code = F.when(unknown, F.raise_error(F.concat(F.lit(f"{f}: unknown category "), key)).cast("int")).otherwise(code)
            elif e.handle_unknown == "ignore":
                tests.append((unknown, A.item(STAGE, f, "unknown_category", F.col(f))))
            if e.strategy in ("label", "ordinal"):
                changes[f] = F.coalesce(code, F.lit(e.unknown_value)) if e.handle_unknown == "use_encoded_value" else code
            elif e.strategy == "one_hot":
                for i, c in enumerate(cats):
                    if not (e.drop_first and i == 0):
                        changes[f"{f}_{c}"] = F.coalesce((code == i).cast("int"), F.lit(0))
            else:
                for i in range(len(cats).bit_length()):  # lowest bit first
                    changes[f"{f}_bin_{i}"] = F.coalesce(F.shiftright(code, i).bitwiseAND(F.lit(1)), F.lit(0))
            if e.strategy in ("one_hot", "binary") and not e.keep_original:
                drop.append(f)
        typed = {}
        base = A.audited(df)
        for c, v in changes.items():  # codes change a column's type: the old value stays only in the errors
            typed[c] = v
        live = F.col(A.VALID) if strict else F.lit(True)
        out = base.withColumn("_new", F.when(live, A.failures(tests)).otherwise(F.array().cast(A.ITEM)))
        out = out.withColumns(typed | {A.ERRORS: F.concat(A.ERRORS, "_new"), A.VALID: F.col(A.VALID) & (F.size("_new") == 0)})
        return out.drop("_new", *drop, *[c for c in out.columns if c.startswith("_c_")])
