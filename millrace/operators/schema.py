"""Schema validation: declared fields alone, coerced leniently; what doesn't coerce is an error."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import casting as K
from millrace.operators import audit as A

STAGE = "schema"


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    required: bool = True
    default: Any = None


def fields_of(schema: Any = None, field_types: dict[str, str] | None = None, required: list[str] | None = None) -> list[Field]:
    """Fields from a list of field dicts, a {"fields": [...]} dict, or names with types."""
    if isinstance(schema, dict):
        schema = schema.get("fields", [])
    if schema:
        return [f if isinstance(f, Field) else Field(f["name"], f.get("type", "str"), f.get("required", True), f.get("default")) for f in schema]
    return [Field(n, t, n in (required or [])) for n, t in (field_types or {}).items()]


def coerced(c: Column, kind: T.DataType, target: str) -> Column:
    """Lenient coercion: whole numbers for int, no numbers for str; null if it isn't possible."""
    target = K.TYPE_NAMES.get(target, "string")
    if target == "string":
        return c if K.is_text(kind) else F.lit(None).cast("string")
    if target == "int":
        v = K.to_float(c, kind)
        return F.when((v == F.floor(v)) & (F.abs(v) < 9.2e18) & ~(c.rlike("[eE]") if K.is_text(kind) else F.lit(False)), v.cast("bigint"))
    if target == "bool":
        if K.is_number(kind):
            return F.when(c == 1, True).when(c == 0, False)
        return K.to_bool(c, kind)
    return K.convert(c, kind, target)


def validate(df: DataFrame, fields: list[Field], strict: bool = False) -> DataFrame:
    """Coerce and project to the declared fields (audit columns stay); no fields: as it is.

    With ``strict`` the first row that fails raises.
    """
    if not fields:
        return A.audited(df)
    df = A.audited(df)
    tests, changes = [], {}
    for f in fields:
        there = f.name in df.columns
        kind = df.schema[f.name].dataType if there else T.StringType()
        c = F.col(f.name) if there else F.lit(None).cast("string")
        v = coerced(c, kind, f.type)
        if f.required:
            tests.append((c.isNull(), A.item(STAGE, f.name, "required", c)))
        tests.append((c.isNotNull() & v.isNull(), A.item(STAGE, f.name, f"not_{K.TYPE_NAMES.get(f.type, 'string')}", c)))
        changes[f.name] = v if f.default is None else F.coalesce(v, F.lit(f.default).cast(_spark(f.type)))
    errors = A.failures(tests)
    if strict:
        errors = F.when(F.size(errors) > 0, F.raise_error(F.concat(F.lit("schema: "), F.to_json(errors))).cast(A.ITEM)).otherwise(errors)
    kept = [c for c in df.columns if c.startswith("_")]
    out = df.withColumn("_new", errors)
    cols = [v.alias(n) for n, v in changes.items()]
    audit = {A.ERRORS: F.concat(A.ERRORS, "_new"), A.VALID: F.col(A.VALID) & (F.size("_new") == 0)}
    return out.select(*cols, *[audit.get(c, F.col(c)).alias(c) for c in kept])


def _spark(name: str) -> str:
    return {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}[K.TYPE_NAMES.get(name, "string")]


@dataclass
class Validator:
    """A schema that can be swapped between batches."""

    fields: list[Field]
    strict: bool = False

    def swap(self, schema: Any = None, field_types: dict[str, str] | None = None, required: list[str] | None = None) -> None:
        self.fields = fields_of(schema, field_types, required)

    def apply(self, df: DataFrame) -> DataFrame:
        return validate(df, self.fields, self.strict)
