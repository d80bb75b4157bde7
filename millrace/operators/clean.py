"""Cleaning rules: ranges, value lists and patterns, with an action for what breaks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import casting as K
from millrace.operators import audit as A

STAGE = "clean"
ACTIONS = ("reject", "remove_field", "cap", "clip", "log_warn")
# The names of errors.
NOT_ALLOWED, FORBIDDEN = "value_not_allowed", "value_forbidden"


@dataclass(frozen=True)
class Rule:
    """Bounds are inclusive; null passes a range, fails allowed_values; a pattern is anchored at the start and reads text alone."""

    field: str
    action: str | None = None  # none: the action that all rules share
    min_value: Any = None
    max_value: Any = None
    allowed_values: list | None = None
    forbidden_values: list | None = None
    pattern: str | None = None
    custom: Callable[[Column], Column] | None = field(default=None, compare=False)

    def tests(self, df: DataFrame) -> list[tuple[str, Column]]:
        c, kind = F.col(self.field), df.schema[self.field].dataType
        out = []
        if self.min_value is not None:
            out.append(("below_minimum", c < F.lit(self.min_value)))
        if self.max_value is not None:
            out.append(("above_maximum", c > F.lit(self.max_value)))
        if self.allowed_values is not None:
            out.append((NOT_ALLOWED, ~_among(c, self.allowed_values)))
        if self.forbidden_values is not None:
            out.append((FORBIDDEN, _among(c, self.forbidden_values)))
        if self.pattern is not None and K.is_text(kind):
            out.append(("pattern_mismatch", ~c.rlike(f"^(?:{self.pattern})")))
        if self.custom is not None:
            out.append(("custom", ~self.custom(c)))
        return [(n, F.coalesce(t, F.lit(False))) for n, t in out]


def _among(c: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    return F.coalesce(c.isin(*known), F.lit(False)) | (c.isNull() if None in values else F.lit(False))


def rules_of(config: Any) -> list[Rule]:
    """From {field: {...}} or [{"field": ..., ...}]; of two rules for a field the last counts."""
    items = config.items() if isinstance(config, dict) else [(r["field"], r) for r in config]
    names = {"min_value", "max_value", "allowed_values", "forbidden_values", "pattern", "action"}
    last = {f: r if isinstance(r, Rule) else Rule(f, **{k: v for k, v in r.items() if k in names}) for f, r in items}
    return list(last.values())


def clean(df: DataFrame, rules: list[Rule], strict: bool = False, action: str = "reject") -> DataFrame:
    """Apply the rules; every check sees the value as it came. ``action``: of rules without their own. capped_fields: names of capped columns."""
    df = A.audited(df)
    errors, warnings, changes, capped = [], [], {}, []
    for r in {r.field: r for r in rules}.values():
        if r.field not in df.columns:
            continue
        how = r.action or action
        if how not in ACTIONS:
            raise ValueError(f"unknown action {how}")
        c, tests = F.col(r.field), r.tests(df)
        items = [(t, A.item(STAGE, r.field, n, c)) for n, t in tests]
        inside = [n in ("below_minimum", "above_maximum") for n, _ in tests]
        if how == "log_warn":
            warnings += items
        elif how == "remove_field":
            broken = F.lit(False)
            for t, _ in items:
                broken = broken | t
            changes[r.field] = F.when(broken, F.lit(None)).otherwise(c)
        elif how in ("cap", "clip"):
            v = c
            if r.min_value is not None:
                v = F.when(c < F.lit(r.min_value), F.lit(r.min_value).cast(df.schema[r.field].dataType)).otherwise(v)
            if r.max_value is not None:
                v = F.when(c > F.lit(r.max_value), F.lit(r.max_value).cast(df.schema[r.field].dataType)).otherwise(v)
            changes[r.field] = v
            capped += [F.when(t, F.lit(r.field)) for (t, _), b in zip(items, inside, strict=True) if b]
            errors += [x for x, b in zip(items, inside, strict=True) if not b]  # only ranges can be capped
        else:
            errors += items
    if capped:
        changes["capped_fields"] = F.array_distinct(F.filter(F.array(*capped), lambda x: x.isNotNull()))
    return A.applied(df, A.failures(errors), changes, A.failures(warnings), strict)


@dataclass
class Cleaner:
    """Rules that change between batches: one for each field."""

    rules: dict[str, Rule] = field(default_factory=dict)
    action: str = "reject"

    def add(self, rule: Rule) -> None:
        self.rules[rule.field] = rule

    def remove(self, name: str) -> bool:
        return self.rules.pop(name, None) is not None

    def apply(self, df: DataFrame, strict: bool = False) -> DataFrame:
        return clean(df, list(self.rules.values()), strict, self.action)
