"""Lifecycle of a streaming preparation: start, status, stop; accepted and rejected rows to their sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import audit as A


@dataclass
class Counts:
    """What the batches of one query have written, kept where its batches are run."""

    batches: int = 0
    published: int = 0
    failed: int = 0
    by_batch: dict[int, tuple[int, int]] = field(default_factory=dict)

    def add(self, number: int, good: int, bad: int) -> None:
        """A batch that is run again replaces what it had counted; the last few are remembered."""
        old = self.by_batch.pop(number, None)
        if old:
            self.batches, self.published, self.failed = self.batches - 1, self.published - old[0], self.failed - old[1]
        self.by_batch[number] = (good, bad)
        self.batches, self.published, self.failed = self.batches + 1, self.published + good, self.failed + bad
        if len(self.by_batch) > 16:
            del self.by_batch[min(self.by_batch)]


@dataclass
class Running:
    query: StreamingQuery
    checkpoint: str
    counts: Counts | None = None

    def status(self) -> dict:
        """Running flag, batches, rows read, late rows, and the last batch's progress; published, failed and success_rate where accepted and rejected rows are told apart.

        Without counts of its own, rows and batches are those of the recent progress, which Spark bounds.
        """
        progress = self.query.recentProgress
        error = self.query.exception()
        late = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
        out = {"running": self.query.isActive, "batches": len(progress), "rows": sum(p["numInputRows"] for p in progress), "late_rows": late, "last": progress[-1] if progress else None, "error": str(error) if error else None}
        if self.counts is not None:
            c = self.counts
            total = c.published + c.failed
            out |= {"batches": c.batches, "rows": total, "published": c.published, "failed": c.failed, "success_rate": c.published / total if total else 1.0}
        return out

    def stop(self) -> dict:
        self.query.stop()
        return self.status()

    def wait(self) -> dict:
        self.query.awaitTermination()
        return self.status()

    def reset(self) -> None:
        """Stop, and forget offsets and state: the next start reads from the beginning."""
        self.query.stop()
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # another thread has no active one
        at = spark._jvm.org.apache.hadoop.fs.Path(self.checkpoint)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def reconfigured(self, start: Callable[[str], Running]) -> Running:
        """Stop, and start another plan from where this one was: ``start`` takes the checkpoint."""
        self.query.stop()
        return start(self.checkpoint)


def trigger(interval: float | None) -> dict:
    """A polling interval in seconds; without one the query ends with its input."""
    return {"availableNow": True} if interval is None else {"processingTime": f"{interval} seconds"}


def start(df: DataFrame, sink: str, checkpoint: str, rejected: str | None = None, interval: float | None = None, output: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None) -> Running:
    """Write a stream with audit columns as Parquet; rejected rows go to their own folder.

    Each batch writes to a folder named by its id, so that a batch that is run again after a
    failure replaces what it had written.
    """

    counts = Counts()

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            good, bad = A.split(A.audited(rows))
            n = A.audited(rows).agg(F.count_if(A.VALID), F.count_if(~F.col(A.VALID))).first()
            counts.add(number, *n)
            (output(good) if output else good).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            if rejected:
                bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            rows.unpersist()

    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(interval))
    return Running((writer.queryName(name) if name else writer).start(), checkpoint, counts)


def append(df: DataFrame, sink: str, checkpoint: str, interval: float | None = None) -> Running:
    """Write finished rows (append mode) with the exactly-once file sink."""
    return Running(df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger(interval)).start(), checkpoint)
