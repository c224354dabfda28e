"""Models as files, and scoring with them: loaded once per worker, applied to bounded batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Mapping

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from polybag.session import ship_package

# Rows that a model sees at once.
BATCH = 1024

Scorer = Callable[[np.ndarray], np.ndarray]


def ship_model(spark: SparkSession, arrays: Mapping[str, np.ndarray]) -> str:
    """Give the parameters to every executor as one file; its name.

    The file travels once per executor, not with every task, and a lost executor's successor
    fetches it again.
    """
    name = f"model-{uuid.uuid4().hex}.npz"
    path = os.path.join(tempfile.mkdtemp(prefix="polybag-"), name)
    np.savez(path, **arrays)
    spark.sparkContext.addFile(path)
    return name


def ship_file(spark: SparkSession, path: str) -> str:
    """The same for a model file that exists, in any store Spark reads."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def local_file(name: str) -> str:
    """Where a shipped file lies on this machine; for use inside a factory."""
    return SparkFiles.get(name)


def apply_model(df: DataFrame, factory: Callable[[], Scorer], width: int, features: str = "embedding",
                out: str = "scores", batch_size: int = BATCH) -> DataFrame:
    """Add ``out``, an array of scores, by the scorer that ``factory`` makes.

    ``factory`` runs once per Python worker and model, whatever the number of tasks, and returns
    a function (rows, width) -> (rows, classes).  Features are arrays of ``width`` numbers; a row
    whose array is null or of another length gets a null score instead of ending the job.
    """
    ship_package(df.sparkSession)
    predict = predict_batch_udf(factory, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                                input_tensor_shapes=[[width]])
    usable = (F.size(features) == width) & ~F.exists(features, lambda v: v.isNull())
    # The model never sees an unusable row: zeros take its place and its score is dropped.
    zeros = F.array_repeat(F.lit(0.0), width)
    plain = F.when(usable, F.transform(features, lambda v: v.cast("double"))).otherwise(zeros)
    return df.withColumn(out, F.when(usable, predict(plain)))


def linear_model(name: str, scale: float = 1.0) -> Callable[[], Scorer]:
    """Factory of sigmoid scores from a shipped file with ``weights`` (width, classes) and ``bias``."""
    def load() -> Scorer:
        with np.load(local_file(name)) as parameters:
            weights, bias = parameters["weights"], parameters["bias"]

        def score(vectors: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-(scale * (vectors.astype(np.float64) @ weights) + bias)))

        return score

    return load
