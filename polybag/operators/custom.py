"""A metric of the user's own as an aggregate: clear, update, merge, evaluate.

It runs in two stages, like a built-in sum.  A task takes its rows batch by batch into one state
per group and hands on the states, not the rows; states of a group are merged by grouped Arrow
aggregates, first in ``WAYS`` parts, then in one, and evaluated.  So a group may hold any share of
the rows, and the result does not depend on how the rows are cut into partitions as long as
``merge`` and ``update`` agree.

Rows have ``gt``, ``pred`` and ``scores``, arrays of one length; rows with a null among the three are
left out.  A group without rows does not exist, except that of all rows: an empty table gives the
evaluation of the cleared state.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.session import map_arrow, ship_package

# Parts in which the states of a group are merged first.
WAYS = 32
# Groups whose states a task holds before it hands them on.
HELD = 10_000


class Metric(ABC):
    """What a metric must say.  A state is any small value that can be pickled."""

    @abstractmethod
    def clear(self) -> Any:
        """The state before the first row."""

    @abstractmethod
    def update(self, state: Any, gt: np.ndarray, pred: np.ndarray, scores: np.ndarray) -> Any:
        """The state after some rows, each array (rows, labels)."""

    @abstractmethod
    def merge(self, state: Any, other: Any) -> Any:
        """One state for the rows of both."""

    @abstractmethod
    def evaluate(self, state: Any) -> Mapping[str, float | None]:
        """The values, by name."""


class _Mean(Metric):
    """The mean of a number per row."""

    name: str

    def values(self, gt: np.ndarray, pred: np.ndarray, scores: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def clear(self) -> tuple[float, int]:
        return 0.0, 0

    def update(self, state, gt, pred, scores):
        values = self.values(gt, pred, scores)
        return state[0] + float(values.sum()), state[1] + len(values)

    def merge(self, state, other):
        return state[0] + other[0], state[1] + other[1]

    def evaluate(self, state):
        return {self.name: state[0] / state[1] if state[1] else None}


class HammingLoss(_Mean):
    """Share of labels that are predicted wrongly."""

    name = "hamming_loss"

    def values(self, gt, pred, scores):
        return (gt != pred).mean(axis=1)


class OneError(_Mean):
    """Share of rows whose best scored label (the first of equals) is not annotated."""

    name = "one_error"

    def values(self, gt, pred, scores):
        return 1 - gt[np.arange(len(gt)), scores.argmax(axis=1)]


class Together(Metric):
    """Several metrics in one pass."""

    def __init__(self, *metrics: Metric) -> None:
        self.metrics = metrics

    def clear(self):
        return [m.clear() for m in self.metrics]

    def update(self, state, gt, pred, scores):
        return [m.update(s, gt, pred, scores) for m, s in zip(self.metrics, state)]

    def merge(self, state, other):
        return [m.merge(a, b) for m, a, b in zip(self.metrics, state, other)]

    def evaluate(self, state):
        return {k: v for m, s in zip(self.metrics, state) for k, v in m.evaluate(s).items()}


def _matrix(column: pa.Array, rows: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1)


def _updated(metric: Metric, by: list[str], schema: pa.Schema):
    """Rows to (by, part, state), one state per group met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        states: dict[tuple, Any] = {}

        def emitted() -> pa.RecordBatch:
            rows = [(*key, part, pickle.dumps(state)) for key, state in states.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            groups = [((), np.arange(batch.num_rows))]
            if by:
                # Rows in the order of their group, cut where it changes.
                code = table.select(by).append_column("_row", pa.array(np.arange(batch.num_rows))).sort_by(
                    [(c, "ascending") for c in by])
                keys = list(zip(*(code.column(c).to_pylist() for c in by)))
                order = code.column("_row").to_numpy()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                groups = [(keys[a], order[a:b]) for a, b in zip(cuts, cuts[1:])]
            gt, pred, scores = (_matrix(batch.column(batch.schema.get_field_index(c)), batch.num_rows, kind)
                                for c, kind in (("gt", np.int64), ("pred", np.int64), ("scores", np.float64)))
            for key, rows in groups:
                state = states.get(key)
                states[key] = metric.update(metric.clear() if state is None else state,
                                            gt[rows], pred[rows], scores[rows])
            if len(states) > HELD:
                yield emitted()
                states = {}
        if states:
            yield emitted()

    return run


def _merger(metric: Metric):
    @F.arrow_udf("binary")
    def merged(states: pa.Array) -> bytes:
        total = metric.clear()
        for state in states:
            total = metric.merge(total, pickle.loads(state.as_py()))
        return pickle.dumps(total)

    return merged


def custom_metric(evaluated: DataFrame, metric: Metric, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, value): a row per group and value of ``metric.evaluate``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    ship_package(evaluated.sparkSession)
    by = list(by)
    rows = evaluated.where("gt IS NOT NULL AND pred IS NOT NULL AND scores IS NOT NULL").select(
        *by, "gt", "pred", "scores")
    states = StructType([*(rows.schema[c] for c in by), StructField("_part", IntegerType()),
                         StructField("_state", BinaryType())])
    partial = map_arrow(rows, _updated(metric, by, to_arrow_schema(states)), states)
    if not by:
        # All rows are a group, also when there are none.
        cleared = evaluated.sparkSession.createDataFrame([(0, bytearray(pickle.dumps(metric.clear())))], states)
        partial = partial.union(cleared)
    merge = _merger(metric)
    whole = partial.groupBy(*by, (F.col("_part") % WAYS).alias("_way")).agg(
        merge("_state").alias("_state")).groupBy(*by).agg(merge("_state").alias("_state"))

    @F.udf("map<string,double>")
    def values(state: bytes):
        return {k: None if v is None else float(v) for k, v in metric.evaluate(pickle.loads(state)).items()}

    return whole.select(*by, F.explode(values("_state")).alias("metric", "value"))
