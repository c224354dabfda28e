"""Loss of each epoch of a run, given out once when the epoch closes.

``transformWithState`` keeps one small state per (run, epoch) that is open: number of steps, sum of
losses, first and last time.  An epoch closes

* at once, when it has ``steps_per_epoch`` steps, or
* by an event-time timer, when the watermark has passed its last step by ``patience``.

It is then emitted, in append mode, and only a mark stays, which tells late steps from a new
epoch; a second timer removes the mark ``forget`` later.  Steps older than the watermark never
get that far.  So the state holds the open epochs and the marks of a bounded time, however long
the stream runs, and a run of any length is spread over the tasks by its epochs.

Epochs that are still open can be read from the checkpoint's state, while the stream runs or
after it, without closing them.

Rows are (run_id, ts, step, loss).  A null run is a run; rows without step or time are left out,
a null loss counts as a step but not in the mean.  Late steps of a closed epoch change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from polybag.operators.runs import epoch_of
from polybag.session import scratch_path, ship_package
from polybag.sources import folders

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCHS = "run_id string, epoch bigint, loss double, steps bigint, first_us bigint, last_us bigint"
_STATE = "steps bigint, losses bigint, total double, first_us bigint, last_us bigint, closed boolean"
_NOTHING = (0, 0, 0.0, None, None, False)
DAY_MS = 24 * 3600 * 1000


class EpochLoss(StatefulProcessor):
    """State of one (run, epoch)."""

    def __init__(self, steps_per_epoch: int | None, patience_ms: int, forget_ms: int) -> None:
        self.full, self.patience, self.forget = steps_per_epoch, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", _STATE)

    def _timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def _forgotten(self, last_us: int) -> int:
        return last_us // 1000 + self.patience + self.forget

    def _close(self, key: Any, state: tuple) -> Iterator[pd.DataFrame]:
        steps, losses, total, first, last, _ = state
        self.epoch.update((*state[:5], True))
        self._timer(self._forgotten(last))
        yield pd.DataFrame({
            "run_id": [key[0]], "epoch": [key[1]], "loss": [total / losses if losses else None],
            "steps": [steps], "first_us": [first], "last_us": [last]}).astype({"loss": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps, losses, total, first, last, closed = (
            tuple(self.epoch.get()) if self.epoch.exists() else _NOTHING)
        if closed and self._forgotten(last) <= timerValues.getCurrentWatermarkInMs():
            steps, losses, total, first, last, closed = _NOTHING  # its timer is due in this batch
        for part in rows:
            if closed or part.empty:
                continue
            steps, losses = steps + len(part), losses + int(part["loss"].count())
            total += float(part["loss"].sum())
            low, high = int(part["us"].min()), int(part["us"].max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
        if closed:
            return
        state = steps, losses, total, first, last, False
        if self.full is not None and steps >= self.full:
            yield from self._close(key, state)
        else:
            self.epoch.update(state)
            self._timer(last // 1000 + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.epoch.get())
        if state[5]:
            self.epoch.clear()
        else:
            yield from self._close(key, state)

    def close(self) -> None:
        pass


def closed_epochs(log_stream: DataFrame, steps_per_epoch: int, complete: bool = True,
                  delay: str = "0 seconds", patience_ms: int = 0, forget_ms: int = DAY_MS) -> DataFrame:
    """A stream of epochs, each once, of a stream of (run_id, ts, step, loss).

    ``complete`` says that an epoch has all its ``steps_per_epoch`` steps in its run, so that it
    closes with the last; otherwise it closes by time alone.
    """
    ship_package(log_stream.sparkSession)
    steps = log_stream.where("step IS NOT NULL AND ts IS NOT NULL").select(
        F.col("run_id").cast("string").alias("run_id"), epoch_of("step", steps_per_epoch).alias("epoch"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("loss").cast("double").alias("loss"))
    return steps.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).groupBy(
        "run_id", "epoch").transformWithStateInPandas(
        EpochLoss(steps_per_epoch if complete else None, patience_ms, forget_ms), EPOCHS, "append", "eventTime")


def start_epochs(epochs: DataFrame, write, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand the epochs that close in a batch to ``write(rows, batch_id)``.

    The query takes RocksDB for its state, as timers need it; the session's choice stays.
    """
    conf = epochs.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = epochs.writeStream.outputMode("append").foreachBatch(write).option(
            "checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def open_epochs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The epochs that have begun and not closed, read from the state of the last batch."""
    if not folders.exists(spark, f"{checkpoint.rstrip('/')}/state"):
        return spark.createDataFrame([], EPOCHS)
    _ = spark.streams.active  # the reader asks the coordinator that the first stream brings
    state = spark.read.format("statestore").option("stateVarName", "epoch").load(checkpoint)
    return state.where("NOT value.closed").select(
        "key.run_id", "key.epoch",
        F.when(F.col("value.losses") > 0, F.col("value.total") / F.col("value.losses")).alias("loss"),
        "value.steps", "value.first_us", "value.last_us")


def epochs_so_far(log_stream: DataFrame, steps_per_epoch: int, complete: bool = False) -> DataFrame:
    """All that a stream has to offer now: the closed epochs and those still open."""
    spark = log_stream.sparkSession
    out, checkpoint = scratch_path(spark, "epochs"), scratch_path(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    start_epochs(closed_epochs(log_stream, steps_per_epoch, complete), write, checkpoint).awaitTermination()
    closed = (spark.read.schema(f"{EPOCHS}, batch bigint").parquet(out).drop("batch")
              if folders.exists(spark, out) else spark.createDataFrame([], EPOCHS))
    return closed.withColumn("closed", F.lit(True)).unionByName(
        open_epochs(spark, checkpoint).withColumn("closed", F.lit(False)))
