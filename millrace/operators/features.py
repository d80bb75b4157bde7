"""Derived features: every definition reads the input row; a later one of the same name wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import casting as K
from millrace.functions import expressions as X
from millrace.functions import scalars as S
from millrace.operators import audit as A

STAGE = "features"
TYPES = ("arithmetic", "datetime", "text", "interaction", "conditional", "custom")
_CASTS = {"float": "double", "int": "bigint", "str": "string", "bool": "boolean"}


@dataclass(frozen=True)
class Feature:
    """``expression``: arithmetic or conditional text, or a part's name; ``custom`` takes the frame and returns a Column."""

    name: str
    type: str
    expression: str = ""
    dependencies: list[str] = field(default_factory=list)
    column: str | None = None
    output_type: str | None = None
    custom: Callable[[DataFrame], Column] | None = None
    description: str = ""


def _first_of(df: DataFrame, kinds: tuple) -> str | None:
    return next((f.name for f in df.schema if isinstance(f.dataType, kinds) and not f.name.startswith("_")), None)


def column_of(df: DataFrame, f: Feature) -> Column:
    none = F.lit(None).cast("double")
    if f.type in ("arithmetic", "interaction"):
        return X.arithmetic(f.expression, df.schema)
    if f.type == "conditional":
        return X.conditional(f.expression, df.schema)
    if f.type == "datetime":
        at = f.column or _first_of(df, (T.TimestampType, T.TimestampNTZType, T.DateType))
        part = S.DATE_PARTS.get(f.expression)
        if at is None or part is None:
            return none
        c = F.col(at)
        return part(c if not K.is_text(df.schema[at].dataType) else K.to_datetime(c))
    if f.type == "text":
        at, part = f.column or _first_of(df, (T.StringType,)), S.TEXT_PARTS.get(f.expression)
        return none if at is None or part is None else part(F.col(at))
    if f.type == "custom" and f.custom is not None:
        return f.custom(df)
    raise ValueError(f"unknown feature type {f.type}")


def build(df: DataFrame, features: list[Feature], safe_mode: bool = True, strict: bool = False) -> DataFrame:
    """Add the features; a missing dependency is an error of every row, or raises without ``safe_mode``."""
    df = A.audited(df)
    tests, new = [], {}
    for f in features:
        lost = [d for d in f.dependencies if d not in df.columns]
        if lost and not safe_mode:
            raise ValueError(f"{f.name}: missing {', '.join(lost)}")
        if lost:
            tests.append((F.lit(True), A.item(STAGE, f.name, f"missing_dependency {','.join(lost)}", F.lit(None))))
            continue
        c = column_of(df, f)
        new[f.name] = c.cast(_CASTS[f.output_type]) if f.output_type else c
    return A.applied(df, A.failures(tests), new, strict=strict) if tests else df.withColumns(new)


@dataclass
class Builder:
    """Feature definitions that change between batches: one for each name."""

    features: dict[str, Feature] = field(default_factory=dict)
    safe_mode: bool = True

    def add(self, feature: Feature) -> None:
        self.features[feature.name] = feature

    def remove(self, name: str) -> bool:
        return self.features.pop(name, None) is not None

    def apply(self, df: DataFrame, strict: bool = False) -> DataFrame:
        return build(df, list(self.features.values()), self.safe_mode, strict)
