"""A table that is appended to batch by batch, each batch once however often its job runs.

A batch lies in ``path/writer=<name>/batch=<number>``.  The folder's commit mark makes it part of
the table: ``append_batch`` skips a batch that has one and overwrites what a failed attempt left
without one, and ``read_batches`` passes over folders that have none.  So a job that is run again,
a stream that repeats its last batch and a writer that dies half-way leave the same table.

Batches without rows count as written.  Rows may carry columns named writer or batch no more than
a partitioned table may.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from polybag.sources import folders

WRITER, BATCH = "writer", "batch"


def _folder(path: str, writer: str, batch: int) -> str:
    return f"{path.rstrip('/')}/{WRITER}={quote(writer, safe='')}/{BATCH}={int(batch)}"


def append_batch(rows: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Add the rows of a batch; False if they had been added before."""
    clash = {WRITER, BATCH} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would hide those of the table")
    target = _folder(path, writer, batch)
    if folders.committed(rows.sparkSession, target):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the table, found by their marks in one listing."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(
        f"{path.rstrip('/')}/{WRITER}=*/{BATCH}=*/{folders.COMMITTED}")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getParent().toString() for s in files.globStatus(pattern) or [])


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed batches, with the columns ``writer`` and ``batch``."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    whole = StructType([*schema, StructField(WRITER, StringType()), StructField(BATCH, LongType())])
    found = committed_batches(spark, path)
    if not found:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*found)


def drop_batches(spark: SparkSession, path: str, writer: str) -> None:
    """Take a writer's batches back, so that it may start anew."""
    folders.remove(spark, f"{path.rstrip('/')}/{WRITER}={quote(writer, safe='')}")
