"""Multi-valued label tables: frequencies, vocabulary, filtering, encoding.

A label table has columns ``sid`` (any type), ``label`` (codes joined by ``;``, kept as text)
and ``ord`` (BIGINT row order, used for "first appearance" and "last row wins").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.functions import label_codes, multi_hot


def explode_labels(labels: DataFrame, separator: str = ";") -> DataFrame:
    """One row per (sid, position, code)."""
    return labels.select(
        "sid", "ord", F.posexplode(label_codes("label", separator)).alias("pos", "code"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The last row of each sid, by ``ord``."""
    return labels.groupBy("sid").agg(
        F.max_by("label", "ord").alias("label"), F.max("ord").alias("ord"))


def label_frequency(labels: DataFrame, separator: str = ";") -> DataFrame:
    """How often each code occurs, over all rows (repeated sids included)."""
    return explode_labels(labels, separator).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))


def top_labels(labels: DataFrame, k: int, separator: str = ";") -> DataFrame:
    """The vocabulary: the ``k`` most frequent codes, ties by first appearance.

    Columns ``code, idx, n``; ``idx`` is the code's column in every encoding.
    """
    codes = label_codes("label", separator)
    occurrences = (
        labels.select("ord", codes.alias("codes"))
        .select("ord", "codes", F.explode("codes").alias("code"))
        # The first place in the row, also for a repeated code: min_by below stays exact.
        .select("ord", "code", F.array_position("codes", F.col("code")).alias("pos"))
    )
    # Fixed-width buffers (no min over structs) keep this a hash aggregate.
    ranked = occurrences.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ord").alias("first_ord"),
        F.min_by("pos", "ord").alias("first_pos"),
    )
    order = [F.col("n").desc(), F.col("first_ord"), F.col("first_pos")]
    best = ranked.orderBy(*order).limit(k)
    # At most k rows are left, so an unpartitioned window is fine.
    return best.select(
        "code", (F.row_number().over(Window.orderBy(*order)) - 1).alias("idx"), "n")


def vocabulary_codes(vocabulary: DataFrame) -> list[str]:
    """The codes in column order, on the driver: the class list of a model, k entries."""
    return [row["code"] for row in vocabulary.orderBy("idx").collect()]


def _literals(codes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in codes]).cast("array<string>")


def vocabulary_check(vocabulary: DataFrame, k: int) -> DataFrame:
    """Were there fewer codes than asked for?"""
    found = F.count(F.lit(1))
    return vocabulary.agg(
        F.lit(k).cast("bigint").alias("requested_k"),
        found.alias("found_k"),
        (found < k).cast("int").alias("too_few"),
    )


def filter_top_labels(labels: DataFrame, vocabulary: Sequence[str],
                      separator: str = ";") -> DataFrame:
    """Keep vocabulary codes in row order; drop sids left with none.  Adds ``codes``.

    The semi-join with the vocabulary happens inside each row: no explode, no regrouping.
    """
    kept = F.filter(
        label_codes("label", separator),
        lambda code: F.array_contains(_literals(vocabulary), code),
    )
    return labels.withColumn("codes", kept).where(F.size("codes") > 0).drop("label")


def encode_labels(filtered: DataFrame, vocabulary: Sequence[str], out: str = "gt") -> DataFrame:
    """Add the 0/1 annotation array of ``codes``."""
    return filtered.withColumn(out, multi_hot("codes", _literals(vocabulary)))


def long_annotations(encoded: DataFrame, example: str = "sid") -> DataFrame:
    """(example, label_idx, gt) rows of a wide encoding."""
    return encoded.select(example, F.posexplode("gt").alias("label_idx", "gt"))
