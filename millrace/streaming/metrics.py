"""Statistics of streams: attempts, rows, rates, late rows, recent errors, and what batches observe, as a table."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Stats(StreamingQueryListener):
    """Totals over all queries of a session; the last 100 errors."""

    def __init__(self):
        self.batches = self.rows = self.late = self.failed = 0
        self.first = self.last = None
        self.errors: deque[str] = deque(maxlen=100)

    @classmethod
    def attached(cls, spark: SparkSession) -> Stats:
        stats = cls()
        spark.streams.addListener(stats)
        return stats

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.first = self.first or p.timestamp
        self.last = p.timestamp

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed += 1
            self.errors.append(event.exception)

    def summary(self) -> dict:
        total = self.batches + self.failed
        return {"batches": self.batches, "rows": self.rows, "late_rows": self.late, "failed": self.failed, "first": self.first, "last": self.last, "success_rate": self.batches / total if total else 1.0, "recent_errors": list(self.errors)[-10:]}


class MetricsTable(StreamingQueryListener):
    """Observed metrics of a session's streams as files, one for each query and batch: a batch that runs again replaces what it had said."""

    SCHEMA = "query string, batch bigint, rows bigint, name string, metrics map<string,double>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def attached(cls, spark: SparkSession, path: str) -> MetricsTable:
        table = cls(spark, path)
        spark.streams.addListener(table)
        return table

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            metrics = {k: float(v) for k, v in row.asDict().items() if isinstance(v, (int, float))}
            line = json.dumps({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "name": name, "metrics": metrics})
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.id}-{name}-{p.batchId}.json")
            out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
            out.write(bytearray(line.encode()))
            out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def batches(self) -> DataFrame:
        """query, batch, rows, name, metrics."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMA).json(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        """query, name, metric, total: sums over batches."""
        return self.batches().select("query", "name", F.explode("metrics").alias("metric", "value")).groupBy("query", "name", "metric").agg(F.sum("value").alias("total"))
