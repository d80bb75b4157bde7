"""Files as sources: CSV with all columns as text, JSON, Parquet, JDBC; batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = False, escape: str = "\\") -> DataFrame:
    """Header names the columns, every value is text; only the header is read to plan. Quoted newlines need ``multiline``, which reads a file in one task; ``escape`` stands before quotes in quoted values."""
    reader = spark.read.option("header", True).option("escape", escape).option("inferSchema", False).option("encoding", "UTF-8").option("multiLine", multiline)
    return reader.schema(text_schema(columns)).csv(path) if columns else reader.csv(path)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_stream(spark: SparkSession, path: str, columns: list[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream over a folder; a batch takes at most ``files_per_batch`` files."""
    schema = text_schema(columns) if columns else csv(spark, path).schema
    reader = spark.readStream.option("header", True).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(path)


def json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def estimated_rows(spark: SparkSession, path: str, sample: int = 1000) -> int:
    """About how many rows the text files under ``path`` hold: their bytes over the mean length of their first lines, headers aside."""
    lines = spark.read.text(path)
    files = lines.inputFiles()
    fs = spark._jvm.org.apache.hadoop.fs
    size = sum(fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs.Path(f)).getLen() for f in files)
    mean = lines.limit(sample).agg(F.avg(F.octet_length("value") + 1)).first()[0]
    return max(0, round(size / mean) - len(files)) if mean else 0


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A database table; with a numeric column and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def read(spark: SparkSession, config: dict) -> DataFrame:
    """By ``{"type": "csv" | "json" | "parquet" | "jdbc" | "kafka", "path": ..., "stream": bool, ...}``."""
    kind, stream = config.get("type", "csv"), config.get("stream", False)
    if kind == "csv":
        return csv_stream(spark, config["path"], config.get("columns"), config.get("files_per_batch")) if stream else csv(spark, config["path"], config.get("columns"), config.get("multiline", False))
    if kind == "parquet":
        return parquet_stream(spark, config["path"], config.get("files_per_batch")) if stream else parquet(spark, config["path"])
    if kind == "json":
        return json(spark, config["path"], config.get("schema"))
    if kind == "jdbc":
        return jdbc(spark, config["url"], config["table"], **config.get("options", {}))
    if kind == "kafka":  # needs Spark's Kafka connector on the class path
        return (spark.readStream if stream else spark.read).format("kafka").options(**config["options"]).load()
    raise ValueError(f"unknown source type {kind}")
