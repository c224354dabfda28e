"""Linear probe: one sigmoid output per label on precomputed vectors, trained with BCE."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from polybag.session import map_arrow, saved


# Numbers of a sum that travel as one row.
BLOCK = 1 << 16
# Parts in which the tasks' blocks are added up first.
WAYS = 32


@F.arrow_udf(ArrayType(DoubleType()))
def _block_sum(blocks: pa.Array) -> list[float]:
    """Blocks of one place, added number by number."""
    width = len(blocks[0])
    return blocks.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=0).tolist()


def _summed(rows: DataFrame, features: str, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(vectors with a leading 1, annotations)`` over all rows.

    A task adds up its batches and hands on the sum in blocks of ``BLOCK`` numbers.  Blocks of one
    place are added in ``WAYS`` groups and then in one, so that a task of either step holds few
    blocks, however wide the sum is and however many tasks made one.  What comes to the driver
    is the sum, of a size that the model gives and not the table.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(
                    zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                    for c in (features, "gt"))
                sums = part(np.hstack([np.ones((len(x), 1)), x]), y).ravel()
                total = sums if total is None else total + sums
        way = TaskContext.get().partitionId() % WAYS
        for place, start in enumerate(range(0, 0 if total is None else len(total), BLOCK)):
            block = total[start:start + BLOCK]
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([way], pa.int32()),
                 pa.ListArray.from_arrays(np.array([0, len(block)], dtype=np.int32), pa.array(block))],
                ["place", "way", "block"])

    parts = map_arrow(rows, run, "place int, way int, block array<double>")
    sums = parts.groupBy("place", "way").agg(_block_sum("block").alias("block")).groupBy("place").agg(
        _block_sum("block").alias("block")).orderBy("place").collect()
    return np.concatenate([np.empty(0), *(np.array(r.block) for r in sums)])


def fit_probe(train: DataFrame, n_classes: int, features: str = "embedding",
              iterations: int = 20, penalty: float = 1e-3) -> tuple[list[list[float]], list[float]]:
    """(weights, intercepts), one logistic regression per label.

    ``train`` has the feature array and ``gt``.  One pass sums the vectors' products, a bound of
    the curvature of every label's loss; then each iteration is one pass that sums the gradients of
    all labels at once, and a step with the bound's inverse and momentum on the driver.
    """
    rows = saved(train.select(features, "gt"), "probe")
    gram = _summed(rows, features, lambda x, _: x.T @ x)
    if not len(gram):
        raise ValueError("no rows to fit")
    size = int(round(len(gram) ** 0.5))
    gram = gram.reshape(size, size)
    n = gram[0, 0]
    # The intercept is not penalised.
    ridge = np.r_[0.0, np.full(size - 1, penalty)]
    step = np.linalg.pinv(gram / (4 * n) + np.diag(ridge), hermitian=True)
    weights = before = np.zeros((size, n_classes))
    for i in range(iterations):
        ahead = weights + i / (i + 3) * (weights - before)

        def gradient(x: np.ndarray, y: np.ndarray, at: np.ndarray = ahead) -> np.ndarray:
            return x.T @ (1 / (1 + np.exp(-(x @ at))) - y)

        slope = _summed(rows, features, gradient).reshape(size, n_classes) / n + ridge[:, None] * ahead
        before, weights = weights, ahead - step @ slope
    return weights[1:].T.tolist(), weights[0].tolist()


def probe_scorer(weights: list[list[float]], intercepts: list[float]):
    """A scorer for :func:`polybag.operators.scoring.apply_scorer`."""
    w, b = np.array(weights).T, np.array(intercepts)

    def score(vectors: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(vectors.astype(np.float64) @ w + b)))

    return score
