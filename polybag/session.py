"""Session defaults, and the shared folder that long jobs write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from polybag.sources import folders

# Settings for sessions we create ourselves (tests, bench, scripts).  A cluster's own session
# is never changed by the operators.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Column calls need not record where they were written.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "polybag", **conf) -> SparkSession:
    """A session with this library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    folder would be lost with its machine, so there we ask for the setting instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="polybag-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# The folder of the job in progress, if any.
_JOB: ContextVar[str | None] = ContextVar("polybag_job", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of the job in progress, or else below the shared folder."""
    folder = _JOB.get() or shared_dir(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """All that is saved inside the block lies in one folder, which goes when the block ends.

    Write or collect the result inside: a DataFrame that reads a saved table is of no use later.
    The folder is removed after a failure too; one whose driver died is left for
    ``retention.expire_outputs``.  Blocks may be nested; the folder of the inner one goes first.
    """
    path = scratch_path(spark, name)
    outer = _JOB.set(path)
    try:
        yield path
    finally:
        _JOB.reset(outer)
        folders.remove(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and continue from the written copy.

    For a result that several later steps read: it is computed once, all of them see the very
    same rows (also when an executor is lost in between), and the plan starts afresh from a
    file scan with pruning and sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many_tasks(spark: SparkSession) -> int:
    """A number of partitions for rows that are few in bytes but long in work: Spark does not merge them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Does what ``spark-submit --py-files`` does, for a session started without it.
    """
    context = spark.sparkContext
    if getattr(context, "_polybag_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="polybag-"), "polybag.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._polybag_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package available to ``fn``."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_pandas(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with this package available to ``fn``."""
    ship_package(df.sparkSession)
    return df.mapInPandas(fn, schema)
