"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a frame
that the next one reads from Parquet. All but the last return the columns of ``documents``; further
columns of ``docs`` are not read. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, decontam, minhash, pieces, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    It is fitted on labelled rows of ``docs`` outside the held-out fold. Null and empty texts score the curve's
    value at no difference; rows without doc_id are scored alike; repeated rows stay or go together.
    """
    model = quality.trained(spark, sf_dir, docs)
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: one with the least doc_id, nulls last.

    Null and empty texts are one class; of texts without words only equal ones are alike; of rows that repeat
    an id with another text each is judged by its own text.
    """
    return minhash.deduplicated(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go.

    Null and empty texts have no words and stay; rows without doc_id, and rows that repeat an id, are judged by their own text.
    """
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"))
    bad = decontam.report(named, common.table(spark, sf_dir, "benchmark"), ("doc_id", "_h")).where("contaminated")
    bad = common.written(bad.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_bad")).distinct(), "contaminated")
    small = decontam.small(bad)
    return named.join(small, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_bad")), "left_anti").select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in all texts; n_chars follows. A null text stays null, and so is its n_chars."""
    out = pii.replaced(docs.select(*COLUMNS), pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text. Null and empty texts have no ids."""
    out = pieces.encoded(docs, pieces.model_bytes(), ("doc_id", "lang", "source", "n_chars"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written on its way goes once its result is stored, and so does the result before it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as made:
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept = made.pop()
        if before:
            common.delete(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the sketch and the lattice have no SQL form; tests/llm/test_pipeline.py holds each stage's rows against plain Python.
ORACLE_SQL = None
