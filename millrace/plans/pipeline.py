"""Configuration to pipeline: validate, transform, build features, wrap; fitted once, applied to batches and streams."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import aggregates, audit, clean, convert, duplicates, encode, features, missing, normalize, observed, schema, windows
from millrace.session import drop_written, written


#: Stages that reject rows, by the names in their errors.
STAGES = [m.STAGE for m in (schema, missing, duplicates, convert, clean, encode, normalize, features)]


def on(config: dict | None) -> bool:
    """A stage runs only with enabled: true."""
    return bool(config) and config.get("enabled") is True


def first(config: dict, *names: str, default: Any = None) -> Any:
    """The value under the first of several spellings."""
    return next((config[n] for n in names if n in config), default)


def merged(*configs: dict) -> dict:
    """Later ones (explicit settings) win over earlier ones (defaults), block by block."""
    out: dict = {}
    for c in configs:
        for k, v in (c or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass
class Pipeline:
    """Stages in order: schema, missing values, duplicates; conversion, cleaning, encoding, scaling; features, windows, aggregations."""

    config: dict
    order: str
    strict: bool = False
    fitted: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict | str, order: str, defaults: dict | None = None, overrides: dict | None = None) -> Pipeline:
        """``overrides`` win over ``config``, and that over ``defaults``, block by block."""
        config = merged(defaults or {}, json.loads(config) if isinstance(config, str) else config, overrides or {})
        return cls(config, order, bool(config.get("strict_mode", False)))

    def validate(self, df: DataFrame) -> DataFrame:
        v = self.config.get("validation", {})
        df = audit.audited(df)
        if on(s := v.get("schema")):
            fields = schema.fields_of(s.get("fields"), s.get("field_types"), s.get("required_fields"))
            df = schema.validate(df, fields, bool(s.get("strict", False)))
        if on(m := first(v, "missing_value", "missing_values")):
            df = missing.impute(df, m.get("columns"), m.get("strategy", "fill_constant"), m.get("fill_values"), m.get("required_fields"), m.get("field_config"), self.order, m.get("partition_by"), m.get("mode", "batch"), self.strict)
        if on(d := first(v, "duplicate", "duplicates")):
            df = duplicates.dedup(df, self.order, d.get("key_fields"), d.get("strategy", "reject"), self.strict)
        return df

    def transform(self, df: DataFrame, fit: bool = False) -> DataFrame:
        t = self.config.get("transformation", {})
        if on(c := first(t, "type_conversion", "type_converter")):
            df = convert.convert(df, first(c, "field_types", "type_mapping"), bool(c.get("auto_infer", False)), bool(c.get("fail_on_error", False)), self.strict, formats=c.get("datetime_formats"), true_words=c.get("boolean_true_values"), false_words=c.get("boolean_false_values"))
        if on(c := first(t, "data_cleaning", "cleaning")):
            df = clean.clean(df, clean.rules_of(c.get("rules", {})), self.strict, c.get("global_action", "reject"))
        if on(c := first(t, "encoding", "encoder")):
            names = ("strategy", "ordinal_mapping", "handle_unknown", "unknown_value", "drop_first", "max_categories", "keep_original")
            if fit:
                e = encode.Encoder(first(c, "categorical_fields", "fields", default=[]), **{k: c[k] for k in names if k in c})
                self.fitted["encoder"] = e.fit(audit.split(df)[0], self.order)
            df = self.fitted["encoder"].transform(df, self.strict)
        if on(c := first(t, "normalization", "normalizer")):
            if fit:
                n = normalize.Normalizer(c.get("fields"), c.get("strategy", "min_max"), tuple(c.get("feature_range", (0.0, 1.0))), c.get("with_mean", True), c.get("with_std", True), c.get("clip", False))
                self.fitted["normalizer"] = n.fit(audit.split(df)[0], self.order)
            df = self.fitted["normalizer"].transform(df, self.strict)
        return df

    def enrich(self, df: DataFrame) -> DataFrame:
        f = self.config.get("features", {})
        if on(c := first(f, "feature_builder", "builder")):
            defs = first(c, "features", "feature_definitions", default=[])
            df = features.build(df, [features.Feature(d["name"], first(d, "feature_type", "type"), d.get("expression", ""), d.get("dependencies", []), d.get("column"), d.get("output_type")) for d in defs], c.get("safe_mode", True), self.strict)
        if on(c := first(f, "window_features", "windows")):
            for w in first(c, "windows", "configs", default=[]):
                df = windows.running(df, windows.TimeWindow(w["name"], w["source_field"], w["time_field"], w.get("window_type", "sliding"), windows.duration(w.get("window_size")), windows.duration(w.get("slide_size")), first(w, "aggregations", "functions", default=["count", "mean"]), w.get("group_by") or [], windows.duration(w.get("watermark_delay"))), self.order)
        if on(c := first(f, "aggregation", "aggregations")):
            for a in first(c, "aggregations", "configs", default=[]):
                df = aggregates.running(df, aggregates.Aggregation(a["name"], a["source_field"], a.get("group_by") or [], a.get("functions", ["count", "mean"]), a.get("time_field"), windows.duration(a.get("window"))), self.order)
        return df

    def fit(self, df: DataFrame) -> Pipeline:
        """Learn codes and scales from what the stages before let through; these are run once, into the shared folder."""
        t = self.config.get("transformation", {})
        if on(first(t, "encoding", "encoder")) or on(first(t, "normalization", "normalizer")):
            stored = written(self.validate(df), "pipeline-fit")
            self.transform(stored, fit=True)
            drop_written(stored)
        return self

    def stats(self, df: DataFrame) -> DataFrame:
        """stage, rows, failed: how many rows each stage has rejected (a row counts in each stage that it failed), then all rows as stage ``total``."""
        out = self.apply(df).select(audit.ERRORS, audit.VALID)
        total = out.agg(F.lit("total").alias("stage"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(audit.VALID)).alias("failed"))
        per = out.select(F.explode(F.array_distinct(F.transform(audit.ERRORS, lambda e: e["stage"]))).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("failed"))
        rows = total.first()
        return per.select("stage", F.lit(rows.rows).alias("rows"), "failed").unionByName(total)

    def apply(self, df: DataFrame) -> DataFrame:
        """All stages, with audit columns. On a stream only stages without order across rows may be enabled.

        Batches are stored before features are built, as valid and rejected rows are read apart there; streams go through both branches.
        """
        out = self.transform(self.validate(df))
        if not df.isStreaming:
            out = written(out, "pipeline-apply")
        enriched = self.enrich(out.where(audit.VALID))
        return enriched.unionByName(out.where(~F.col(audit.VALID)), allowMissingColumns=True)

    def observed(self, df: DataFrame) -> observed.Observed:
        """``apply``, with the numbers of ``stats`` once the rows have been written: without a pass of their own."""
        return observed.audited(self.apply(df), STAGES)

    def accepted(self, df: DataFrame) -> DataFrame:
        return self.enrich(self.transform(self.validate(df)).where(audit.VALID)).drop(audit.ERRORS, audit.WARNINGS, audit.VALID)
