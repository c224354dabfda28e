"""The incremental evaluator, as Structured Streaming jobs.

Confusion counts are a handful of counters per label: they are the state of a streaming aggregate.
AUC is not a sum; it needs the number of positives and negatives per (label, score), as many rows
as there are distinct scores.  ``StreamEvaluator`` keeps these as runs of files, so that a batch
costs what it holds, however long the stream has run.  For scores rounded to few places,
``score_state`` is the same as a streaming aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from polybag.operators import auc, metrics
from polybag.session import scratch_path
from polybag.sources import folders
from polybag.streaming.store import FAN, CountStore


def confusion_state(evaluated_stream: DataFrame) -> DataFrame:
    """Running tp, fp, tn, fn per label: the batch operator, on a stream."""
    return metrics.confusion_counts(evaluated_stream)


def score_state(evaluated_stream: DataFrame, by: Sequence[str] = (),
                decimals: int | None = None) -> DataFrame:
    """Running counts per (by, label, score, prediction): enough for the whole report."""
    return auc.outcome_counts(evaluated_stream, by, decimals)


def metrics_of_state(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report of the batch evaluation, (by, metric, label_idx, value), from the score state.

    Counts of a key may be spread over several rows.
    """
    overall, labels = metrics.metrics_of_counts(auc.confusion_of(state, by), by)
    return metrics.report_rows(overall, labels, auc.areas_of(state, by), by)


def start(state: DataFrame, sink: Callable[[DataFrame, int], None],
          checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stateful query that hands its complete state to ``sink`` after each batch."""
    writer = (
        state.writeStream.outputMode("complete")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def final_state(spark: SparkSession, state: DataFrame,
                finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Read everything available, and return the last written state, or what ``finish`` makes of it.

    Each batch replaces the output of the one before it, so a repeated batch does no harm.
    ``finish`` works on the written state: the stateful aggregate runs once per batch, however
    often the result needs its rows.
    """
    out, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "stream")
    result = scratch_path(spark, "result") if finish else out

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)
        if finish:
            written = batch.sparkSession.read.schema(batch.schema).parquet(out)
            finish(written).write.mode("overwrite").parquet(result)

    query = start(state, sink, checkpoint)
    query.awaitTermination()
    if not folders.committed(spark, result):  # nothing has arrived
        nothing = spark.createDataFrame([], state.schema)
        return finish(nothing) if finish else nothing
    return spark.read.parquet(result)


class StreamEvaluator:
    """Evaluation of a stream whose state is a store of counts.

    A micro-batch is counted per (by, label, score, prediction) and appended to the store under
    its batch id; a repeated batch replaces itself.  The report may be asked for at any time, by
    this process or another one that knows the folder.  ``by`` are columns whose values are
    evaluated apart, such as the epoch; ``decimals`` rounds the scores.
    """

    def __init__(self, evaluated_stream: DataFrame, path: str, by: Sequence[str] = (),
                 decimals: int | None = None, fan: int = FAN) -> None:
        self.stream, self.by, self.decimals = evaluated_stream, list(by), decimals
        self.spark, self.path = evaluated_stream.sparkSession, path.rstrip("/")
        empty = self._counts(self.spark.createDataFrame([], evaluated_stream.schema))
        self.store = CountStore(f"{self.path}/counts", empty.schema,
                                [*by, "label_idx", "score", "pred"], fan)

    def _counts(self, evaluated: DataFrame) -> DataFrame:
        return auc.outcome_counts(evaluated, self.by, self.decimals)

    def start(self, once: bool = True, after: Callable[[int], None] | None = None) -> StreamingQuery:
        """Start counting; ``after`` is called with the batch id once a batch is in the store."""
        def add(batch: DataFrame, number: int) -> None:
            self.store.append(self._counts(batch), number)
            if after:
                after(number)

        writer = self.stream.writeStream.foreachBatch(add).option(
            "checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def report(self) -> DataFrame:
        """(by, metric, label_idx, value) over all that has been counted."""
        return metrics_of_state(self.store.rows(self.spark), self.by)


def evaluated_stream(stream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report of everything a stream has to offer now."""
    evaluator = StreamEvaluator(stream, scratch_path(stream.sparkSession, "evaluation"), by)
    evaluator.start().awaitTermination()
    return evaluator.report()
