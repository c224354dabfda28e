"""Scores: apply a scorer, pool instances into bags, attach annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.functions import adaptive_threshold
from polybag.session import map_arrow
from polybag.sources.models import apply_model, linear_model, ship_model


def apply_scorer(df: DataFrame, scorer: Callable[[np.ndarray], np.ndarray],
                 features: str = "embedding", out: str = "scores") -> DataFrame:
    """Run any user scorer ``(n, d) -> (n, classes)`` over Arrow batches.

    Vectors of a batch reach the scorer as one matrix, without a Python object per row.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = batch.column(batch.schema.get_field_index(features))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            result = np.asarray(scorer(flat.reshape(batch.num_rows, -1)), dtype=np.float64)
            offsets = np.arange(0, result.size + 1, result.shape[1], dtype=np.int32)
            scores = pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, run, f"{fields}, `{out}` array<double>")


def class_centroids(vectors: DataFrame, label: str = "label",
                    features: str = "embedding", dims: int = 64) -> DataFrame:
    """Mean vector per class: one hash aggregate with a fixed-width buffer per dimension."""
    means = [F.avg(F.col(features)[i].cast("double")) for i in range(dims)]
    return vectors.groupBy(F.col(label).alias("class")).agg(F.array(*means).alias("centroid"))


def linear_scores(df: DataFrame, weights: DataFrame, scale: float, bias: float,
                  features: str = "embedding", out: str = "scores",
                  decimals: int | None = None) -> DataFrame:
    """Sigmoid of a scaled dot product with each class's weight vector.

    ``weights(class, centroid)`` has one row per class, the parameters of a model: they go to
    the executors as a file that a worker loads once, and the scored table is only scanned.
    """
    matrix = np.array([r["centroid"] for r in weights.orderBy("class").collect()]).T
    name = ship_model(df.sparkSession, {"weights": matrix, "bias": np.full(matrix.shape[1], float(bias))})
    scored = apply_model(df, linear_model(name, scale), len(matrix), features, out)
    if decimals is None:
        return scored
    return scored.withColumn(out, F.transform(out, lambda s: F.round(s, decimals)))


def bag_scores(instances: DataFrame, n_classes: int, keys: Sequence[str] = ("bag_id",),
               scores: str = "scores", decimals: int | None = None) -> DataFrame:
    """Mean score vector of each bag's instances, and how many there were.

    ``keys`` may name further columns that are constant in a bag, such as its entity.

    One hash aggregate with a running sum per class: sums are combined before the shuffle, and
    no score is exploded into its own row.
    """
    def mean(i: int) -> Column:
        value = F.avg(F.col(scores)[i])
        return value if decimals is None else F.round(value, decimals)

    return instances.groupBy(*keys).agg(
        F.array(*[mean(i) for i in range(n_classes)]).alias(scores),
        F.count(F.lit(1)).cast("int").alias("nslice"),
    )


def with_predictions(evaluated: DataFrame, base: float = 0.5, scores: str = "scores") -> DataFrame:
    """Add ``pred``, the thresholded 0/1 array."""
    return evaluated.withColumn("pred", adaptive_threshold(scores, base))


def align(annotations: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Annotations and predictions of the same example, joined by key instead of by position."""
    return annotations.join(predictions, key)


def unmatched(annotations: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only; an empty result means the two sides line up."""
    both = annotations.select(key, F.lit(1).alias("side")).unionByName(
        predictions.select(key, F.lit(2).alias("side")))
    return (
        both.groupBy(key)
        .agg(F.bit_or("side").alias("sides"))
        .where(F.col("sides") != 3)
    )


def wide_scores(long: DataFrame, n_classes: int, example: str = "example_id",
                value: str = "score", out: str = "scores") -> DataFrame:
    """(example, label_idx, value) rows to one array per example."""
    cells = [F.max(F.when(F.col("label_idx") == i, F.col(value))) for i in range(n_classes)]
    return long.groupBy(example).agg(F.array(*cells).alias(out))
