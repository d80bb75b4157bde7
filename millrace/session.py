"""Session settings that the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC makes naive and zoned timestamps agree; AQE merges and splits shuffles by size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "millrace", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. On one machine (local mode) a local one where none is set; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file:/tmp/checkpoints/millrace"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, a lost executor loses nothing."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
