"""What the corpus operators share: words, shared folders, cut lineage, components."""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of digits, a-z and anything outside ASCII (after lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes: A-Z becomes a-z and all other ASCII outside words a space.
BYTE_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    import millrace

    top, app = os.path.dirname(millrace.__file__), spark.sparkContext.applicationId
    if getattr(ship, "app", None) == app:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(at)
    ship.app = app


#: What this Python worker keeps from task to task: of one operator at a time.
_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, once for each Python worker, until another operator's tasks come; what it used besides goes back."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
        given_back()
    return _HELD[key]


def let_go() -> None:
    _HELD.clear()


def given_back() -> None:
    """Free memory of this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library is glibc
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. What other operators held goes first (unless ``run`` itself ``holds``), and free memory goes back at the end.

    Spark keeps idle workers, at times more of them than cores: what each of them holds stands beside the heap of all later stages.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        try:
            yield from run(batches)
        finally:
            given_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written since, for each ``scratch`` that is open.
_OPEN: list[list[str]] = []


#: No ``_SUCCESS`` file: ``written`` reads a table only once its write has ended, and on a local disk Hadoop starts processes from the driver for it.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, a lost executor loses nothing."""
    at = work_path(df.sparkSession, name)
    for made in _OPEN:
        made.append(at)
    df.write.options(**UNMARKED).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    for f in df.inputFiles()[:1]:
        delete(spark, f.rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """At its end all tables written inside are deleted, but for the paths that are taken out of the list it gives.

    For steps that end with a stored result, which needs none of the tables on the way.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            delete(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with at least so many rows may be hot; at most so many keys can hold more than their share of all rows.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, copies: str = "copies") -> DataFrame:
    """``rows`` with the columns of ``table``: unique keys, and ``copies``, how many of ``rows`` have the key.

    Keys that hold more than a 50,000th of all rows, hence fewer than 50,000 of them, are
    broadcast, so that no task gathers the copies of one key; the others are shuffled.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot, rest = table.where(F.col(copies) > bar).drop(copies), table.where(F.col(copies) <= bar).drop(copies)
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def lowered(text: Column) -> Column:
    """A-Z to a-z, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), NOT_WORD), "")


def byte_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTE_TABLE).split()


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: UTF-8 bytes of training text that a fit takes at most.
MOST_BYTES = 64 * 1024 * 1024


def fetched(docs: DataFrame, chosen: DataFrame, most: int, columns: list[str], most_bytes: int = MOST_BYTES) -> list:
    """Rows (doc_id, text, ...) of the documents that ``chosen`` (id, ...; at most ``most`` rows) names, on the driver.

    Bounded in rows and bytes, whatever repeats: of the distinct (doc_id, text) pairs the
    first ``most`` by hash come, each of them whole and only if it fits in what is left of ``most_bytes``.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), *[c for c in columns if c in docs.columns])
    keyed = keyed.join(F.broadcast(chosen.withColumnsRenamed({c: f"_{c}" for c in chosen.columns})), F.col("doc_id") == F.col("_doc_id"))
    keyed = keyed.select("doc_id", "text", "_h", *[F.col(c if c in docs.columns else f"_{c}").alias(c) for c in columns])
    sizes = keyed.groupBy("doc_id", "_h").agg(F.max(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(most).collect()
    left, fits = most_bytes, []
    for r in sizes:
        if r.n <= left:
            left -= r.n
            fits.append((r.doc_id, r["_h"]))
    if not fits:
        return []
    fits = docs.sparkSession.createDataFrame(fits, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _h bigint")
    rows = keyed.join(F.broadcast(fits), ["doc_id", "_h"], "left_semi").groupBy("doc_id", "_h").agg(F.first("text").alias("text"), *[F.min(c).alias(c) for c in columns])
    return sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> list:
    """(text, label) of at most ``most`` labelled training rows, by a hash of doc_id.

    Only ids are sorted; the bounds (``most`` rows, MOST_BYTES) keep the join's small side
    broadcastable and what reaches the driver fixed. Labels that contradict each other drop out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket_of(F.col("doc_id"), folds) != held))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
        .select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return [(r.text, int(r.y)) for r in fetched(docs.select("doc_id", "text"), chosen, most, ["y"])]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + l2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); component: the least node.

    Each round takes the least label among neighbours and then jumps to that label's
    own label; every round is written to the shared folder. Rounds grow with the
    logarithm of a component's diameter. Minima are combined before shuffles and
    hubs are split by skew joins, so no group is gathered in one task.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    for k in itertools.count(1):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = low.join(own, "low", "left").select("node", "label", F.least("low", F.coalesce("up", "low")).alias("new"))
        step = written(new, f"{name}-{k}")
        moved = step.where("new <> label").limit(1).count()
        drop_path(spark, labels)
        labels = step.select("node", F.col("new").alias("label"))
        if not moved:
            drop_path(spark, both)
            return labels.select("node", F.col("label").alias("component"))
