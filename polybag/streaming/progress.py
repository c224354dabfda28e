"""What a running stream reports: one row of the run log per progress event.

``ProgressLog`` is a ``StreamingQueryListener``.  Each event becomes one small file in the folder of
its query and batch, so an event that is told twice is kept once, and the driver holds nothing.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from polybag.sources import folders

PROGRESS = ("query_id string, run_id string, name string, batch bigint, ts timestamp, duration_ms bigint, "
            "input_rows bigint, rows_per_second double, state_rows bigint, state_bytes bigint, "
            "watermark timestamp")


def _row(progress) -> dict:
    states = progress.stateOperators
    watermark = progress.eventTime.get("watermark")
    return {
        "query_id": str(progress.id), "run_id": str(progress.runId), "name": progress.name,
        "batch": progress.batchId, "ts": progress.timestamp,
        "duration_ms": progress.durationMs.get("triggerExecution"),
        "input_rows": progress.numInputRows, "rows_per_second": progress.processedRowsPerSecond,
        "state_rows": sum(s.numRowsTotal for s in states),
        "state_bytes": sum(s.memoryUsedBytes for s in states), "watermark": watermark}


class ProgressLog(StreamingQueryListener):
    """Writes progress of the session's streams below ``path`` until it is closed.

    Use it as a context manager around the streams; ``wait`` returns when a stream's last event
    has come.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ended: dict[str, threading.Event] = {}
        self.failures: list[str] = []

    def _end_of(self, run_id) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(event.runId)

    def onQueryProgress(self, event) -> None:
        row = _row(event.progress)
        try:
            folders.write_text(self.spark, f"{self.path}/query={row['query_id']}/batch={row['batch']:012d}.json",
                               json.dumps(row))
        except Exception as error:  # an exception here would be lost in the listener's thread
            self.failures.append(f"batch {row['batch']}: {error}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        query.awaitTermination()
        if not self._end_of(query.runId).wait(seconds):
            raise TimeoutError("the end of the stream was not reported")
        if self.failures:
            raise OSError("; ".join(self.failures))

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table; empty if no event has been written."""
    if not folders.exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", True).json(path)
