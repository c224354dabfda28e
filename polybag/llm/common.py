"""What the document operators share: tables, words, and a row kept whole beside new columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, UPPER.lower())


def kept_whole(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows as one struct, so that no column of theirs can clash with ``columns``."""
    return df.select(F.struct("*").alias(ROW), *columns)


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")

