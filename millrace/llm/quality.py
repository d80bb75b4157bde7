"""Quality classifier: how much better a dictionary of good text compresses a document than one of bad text.

Two zstandard dictionaries are trained, one from good and one from bad labelled
documents. A text is compressed whole with either; the difference of the two sizes
over the size without a dictionary is the signal, which a logistic curve, fitted on
labelled rows that the dictionaries did not see, turns into a probability.

Nulls and empty texts compress to nothing: their difference is 0 and their score
the curve's value there. Repeated rows score alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Bounds of the fit: labelled rows taken, and bytes of one dictionary.
MOST_LABELLED, DICT_BYTES, LEVEL = 6000, 64 * 1024, 3


def features(texts: list[str | None], good, bad, plain) -> np.ndarray:
    """For each text: size difference over plain size, the same by length, and plain size by length."""
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if raw := (text or "").encode("utf-8", "surrogatepass"):
            g, b, p = len(good.compress(raw)), len(bad.compress(raw)), len(plain.compress(raw))
            out[i] = (b - g) / p, (b - g) / len(raw), p / len(raw)
    return out


def compressors(model: dict) -> tuple:
    make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False)
    return make(model["good"]), make(model["bad"]), make(None)


def dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    parts = [p for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for p in (raw[i : i + 4096] for i in range(0, len(raw), 4096)) if p]
    try:
        return zstandard.train_dictionary(size, parts, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size]


def fit(rows: list[tuple[str, int]], dict_bytes: int = DICT_BYTES) -> dict:
    """Dictionaries from two thirds of each class, the curve from the other third."""
    split = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    learn = {y: [t for i, t in enumerate(ts) if i % 3] for y, ts in split.items()}
    rest = [(t, y) for y, ts in split.items() for i, t in enumerate(ts) if i % 3 == 0]
    n = max(1, min(sum(map(len, ts)) for ts in learn.values()))
    model = {}
    for y, name in ((1, "good"), (0, "bad")):  # as much text for either dictionary
        taken, total = [], 0
        for t in learn[y]:
            if total >= 2 * n:
                break
            taken.append(t)
            total += len(t)
        model[name] = dictionary(taken, dict_bytes)
    if len({y for _, y in rest}) < 2:
        share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        return model | {"w": [0.0, 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))], "mean": [0.0] * 3, "sd": [1.0] * 3}
    x, y = features([t for t, _ in rest], *compressors(model)), np.array([v for _, v in rest], float)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    return model | {"w": C.logistic((x - mean) / sd, y).tolist(), "mean": mean.tolist(), "sd": sd.tolist()}


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted; in one pass, without a shuffle."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    w, mean, sd = (np.array(model[k]) for k in ("w", "mean", "sd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = features(part.column("text").to_pylist(), *tools)
                p = 1 / (1 + np.exp(-np.clip(((x - mean) / sd) @ w[:-1] + w[-1], -30, 30)))
                cols = [*(part.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    kept = docs.columns if keep is None else keep
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(C.thrifty(run), f"{fields}, score double, predicted int")


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, most: int = MOST_LABELLED) -> dict:
    docs = C.table(spark, sf_dir, "documents") if docs is None else docs
    return fit(C.labelled_sample(docs, C.table(spark, sf_dir, "labels"), "quality", 3, 1, most))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", (C.bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
