"""Versioned documents as append-only Parquet: configuration, model states, and stored collections.

Which write was last is told by numbers, not by clocks: a writer takes the next number by creating a file of that name, which only
one can, and appends under it. Files that are made so are atomic on HDFS and its like.
"""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import drop_written, written

CONFIG = "service_name string, config_data string, version int, description string, deleted boolean, updated_at timestamp, seq bigint"


def _made(spark: SparkSession, fs: Any, path: Any) -> bool:
    """Whether the file was made by this call: it must not exist. Hadoop's local file system only looks first, so Java makes local ones."""
    if fs.getScheme() == "file":
        return spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
    except Py4JJavaError:
        if not fs.exists(path):
            raise
        return False
    return True


def claimed(spark: SparkSession, path: str, least: int = 1) -> int:
    """The next number under ``path``, at least ``least``: nobody else gets it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    taken = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
    n = max([least - 1, *taken]) + 1
    at = lambda k: spark._jvm.org.apache.hadoop.fs.Path(folder, f"{k:020d}")
    while not _made(spark, fs, at(n)):
        n += 1
    for old in sorted(taken)[:-10]:  # the last ones tell where to go on
        fs.delete(at(old), False)
    return n


def latest(df: DataFrame, keys: list[str], version: str | Column) -> DataFrame:
    """The row of the highest version of each key: combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version) if isinstance(version, str) else version).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def retained(df: DataFrame, keys: list[str], version: str, most: int = 10) -> DataFrame:
    """The ``most`` highest versions of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def matching(df: DataFrame, query: dict[str, Any] | None = None) -> DataFrame:
    """Rows equal to the query."""
    for k, v in (query or {}).items():
        df = df.where(F.col(k).isNull() if v is None else F.col(k) == v)
    return df


def find(df: DataFrame, query: dict[str, Any] | None = None, sort: list[str | Column] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows equal to the query, sorted, a page of them."""
    df = matching(df, query)
    df = df.orderBy(*sort) if sort else df
    return (df.offset(offset) if offset else df).limit(limit)


def page(df: DataFrame, number: int, size: int, sort: str, descending: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """One page (from 1; at most 100 rows) and total_items, total_pages."""
    size = max(1, min(size, 100))
    total = df.count()
    key = F.col(sort).desc() if descending else F.col(sort)
    return df.orderBy(key).offset((max(1, number) - 1) * size).limit(size), {"total_items": total, "total_pages": -(-total // size), "page": number, "size": size}


#: Versions start anew after a deletion, so the highest number of a write counts.
LAST = ("seq", "updated_at", "version")


class ConfigStore:
    """A document for each service; every change appends a version, the first after a deletion is 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def history(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(CONFIG).parquet(self.path) if there else self.spark.createDataFrame([], CONFIG)

    def list_all(self) -> DataFrame:
        return latest(self.history(), ["service_name"], F.struct(*LAST)).where(~F.col("deleted")).drop("deleted").orderBy("service_name")

    def get(self, name: str) -> dict | None:
        row = latest(self.history().where(F.col("service_name") == name), ["service_name"], F.struct(*LAST)).where(~F.col("deleted")).first()
        return None if row is None else {"service_name": name, "config": json.loads(row.config_data), "version": row.version, "description": row.description}

    def _append(self, name: str, data: str | None, version: int, description: str | None, deleted: bool) -> None:
        row = self.spark.createDataFrame([(name, data, version, description, deleted)], "service_name string, config_data string, version int, description string, deleted boolean")
        row.withColumns({"updated_at": F.current_timestamp(), "seq": F.lit(claimed(self.spark, self._claims(name))).cast("bigint")}).write.mode("append").parquet(self.path)

    def _claims(self, name: str) -> str:
        return f"{self.path}-writes/{quote(name, safe='')}"

    def upsert(self, name: str, data: dict, description: str | None = None, expected: int | None = None) -> int:
        """Version 1, or the next one; a description stays if none is given. With ``expected`` it fails unless that is the current version (0: none)."""
        last = latest(self.history().where(F.col("service_name") == name), ["service_name"], F.struct(*LAST)).first()
        version = 1 if last is None or last.deleted else last.version + 1
        if expected is not None and expected != version - 1:
            raise ValueError(f"{name} is at version {version - 1}, not {expected}")
        kept = description if description is not None else (last.description if last is not None and not last.deleted else None)
        self._append(name, json.dumps(data), version, kept, False)
        return version

    def delete(self, name: str) -> bool:
        now = self.get(name)
        if now is None:
            return False
        self._append(name, None, now["version"] + 1, None, True)
        return True

    def seed(self, defaults: dict[str, dict]) -> int:
        """Insert only services that are missing; returns how many."""
        rows = self.spark.createDataFrame([(k, json.dumps(v)) for k, v in defaults.items()], "service_name string, config_data string")
        new = rows.join(self.list_all().select("service_name"), "service_name", "left_anti")
        n = new.count()
        if n:
            new.select("service_name", "config_data", F.lit(1).alias("version"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("deleted"), F.current_timestamp().alias("updated_at"), F.lit(0).cast("bigint").alias("seq")).write.mode("append").parquet(self.path)
        return n


class Collection:
    """Documents under ids, append-only: save, find, update, delete, count. ``fields`` is the documents' schema."""

    def __init__(self, spark: SparkSession, path: str, fields: str):
        self.spark, self.path = spark, path
        self.schema = f"_id string, _version bigint, _place bigint, _deleted boolean, {fields}"

    def _all(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        return latest(self._all(), ["_id"], F.struct("_version", "_place")).where(~F.col("_deleted")).drop("_deleted", "_version", "_place")

    def _next(self) -> int:
        """A version above all earlier ones; a write reads nothing but the names of the last claims."""
        return claimed(self.spark, f"{self.path}-writes")

    def save(self, rows: DataFrame) -> int:
        """Rows with or without _id; returns how many. Of rows with one _id the last in the frame's order stays."""
        rows = rows if "_id" in rows.columns else rows.withColumn("_id", F.expr("uuid()"))
        return self._write(rows.withColumns({"_version": F.lit(self._next()), "_deleted": F.lit(False)}))

    def find(self, query: dict[str, Any] | None = None, sort: list | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return find(self.current(), query, sort, limit, offset)

    def find_one(self, query: dict[str, Any]) -> dict | None:
        row = self.find(query, limit=1).first()
        return row.asDict() if row else None

    def count(self, query: dict[str, Any] | None = None) -> int:
        return matching(self.current(), query).count()

    def counts(self, field: str) -> DataFrame:
        """field, n: how many documents have each value."""
        return self.current().groupBy(field).agg(F.count(F.lit(1)).alias("n"))

    def _write(self, rows: DataFrame) -> int:
        """Store the rows, then append them: what is read and what is counted is one and the same."""
        rows = rows.withColumn("_place", F.monotonically_increasing_id())
        stored = written(rows.select(*self.spark.createDataFrame([], self.schema).columns), "collection")
        n = stored.count()
        if n:
            stored.write.mode("append").parquet(self.path)
        drop_written(stored)
        return n

    def update(self, query: dict[str, Any], changes: dict[str, Any]) -> int:
        rows = matching(self.current(), query).withColumns({k: F.lit(v) for k, v in changes.items()})
        return self._write(rows.withColumns({"_version": F.lit(self._next()), "_deleted": F.lit(False)}))

    def delete(self, query: dict[str, Any]) -> int:
        return self._write(matching(self.current(), query).withColumns({"_version": F.lit(self._next()), "_deleted": F.lit(True)}))


class StateStore:
    """Model states by name and version; the last ``most`` versions of each count."""

    SCHEMA = "model_name string, state string, version int, saved_at timestamp, metadata string"

    def __init__(self, spark: SparkSession, path: str, most: int = 10):
        self.spark, self.path, self.most = spark, path, most

    def history(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)
        return retained(rows, ["model_name"], "version", self.most)

    def save(self, name: str, state: dict, metadata: dict | None = None) -> int:
        last = self.history().where(F.col("model_name") == name).agg(F.max("version")).first()[0] or 0
        version = claimed(self.spark, f"{self.path}-writes/{quote(name, safe='')}", last + 1)
        row = self.spark.createDataFrame([(name, json.dumps(state), version, json.dumps(metadata or {}))], "model_name string, state string, version int, metadata string")
        row.select("model_name", "state", "version", F.current_timestamp().alias("saved_at"), "metadata").write.mode("append").parquet(self.path)
        return version

    def load(self, name: str, version: int | None = None) -> dict | None:
        rows = self.history().where(F.col("model_name") == name)
        row = (rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version"))).first()
        return json.loads(row.state) if row else None

    def names(self) -> DataFrame:
        return self.history().groupBy("model_name").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("versions")).orderBy("model_name")
