"""Label tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polybag.session import saved

# Both columns stay text: a single code such as 6 must not become a number.
LABEL_SCHEMA = "Gene STRING, label STRING"


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """Read ``Gene,label`` with a header into (sid, label, ord).

    ``ord`` follows the files by name and the rows of each file, wherever Spark starts to read:
    files are ranked, and a row is placed by the start of its block and its place within.  A
    folder has few label files; their names are the only thing ranked in one task.
    """
    rows = spark.read.csv(path, header=True, schema=LABEL_SCHEMA).select(
        F.col("Gene").alias("sid"), "label", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    rows = saved(rows, "labels")
    blocks = rows.groupBy("file", "block").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row per block of the files.
    return rows.join(F.broadcast(starts), ["file", "block"]).select(
        "sid", "label", (F.col("start") + F.col("place") - F.col("first")).alias("ord"))


def scan_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The same with an explicit third column ``ord``."""
    rows = spark.read.csv(path, header=True, schema=LABEL_SCHEMA + ", ord BIGINT")
    return rows.select(F.col("Gene").alias("sid"), "label", "ord")


def write_labels(labels: DataFrame, path: str) -> None:
    """Write (sid, label, ord) as CSV."""
    labels.select(F.col("sid").cast("string").alias("Gene"), "label", "ord").write.csv(
        path, header=True, mode="overwrite")
