"""Seeded order and exact-proportion splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.operators.skew import hashed_rank

# The seed and the cut points of train/val/test = 4:1:5.
SPLIT_SEED = 286501567
TRAIN_CUT = 0.4
VAL_CUT = 0.5


def seeded_order(df: DataFrame, key: str = "sid", seed: int = SPLIT_SEED,
                 rank: str = "rank", total: str | None = None, digits: int | None = None) -> DataFrame:
    """A reproducible shuffle: rows numbered in the order of a seeded hash of their key."""
    return hashed_rank(df, key, rank=rank, total=total, seed=seed, digits=digits)


def split_assign(sids: DataFrame, key: str = "sid", seed: int = SPLIT_SEED,
                 digits: int | None = None) -> DataFrame:
    """Add ``split``: the first floor(.4 n) of the seeded order train, up to floor(.5 n) val.

    ``sids`` has one row per entity, so no bag of an entity can leak into another split.
    The sizes are exact; which entities land where is ours (hash order).
    """
    ranked = seeded_order(sids, key, seed, "_rank", "_n", digits)
    rank, n = F.col("_rank"), F.col("_n")
    split = (
        F.when(rank < F.floor(n * F.lit(TRAIN_CUT)), "train")
        .when(rank < F.floor(n * F.lit(VAL_CUT)), "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_rank", "_n")


def in_split(df: DataFrame, mode: str) -> DataFrame:
    """Rows of a mode; ``pretrain`` and ``train`` both read the train split."""
    wanted = {"pretrain": "train", "train": "train", "val": "val", "test": "test"}[mode]
    return df.where(F.col("split") == wanted)


def split_summary(split_labels: DataFrame, batch_size: int) -> DataFrame:
    """Entities, label instances and whole batches per split (needs ``codes``)."""
    return split_labels.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_sids"),
        F.sum(F.size("codes")).alias("n_labels"),
        F.expr(f"count(1) div {int(batch_size)}").alias("n_batches"),
    )


def split_label_counts(split_labels: DataFrame) -> DataFrame:
    """Class balance: occurrences of each code per split (needs ``codes``)."""
    return (
        split_labels.select("split", F.explode("codes").alias("code"))
        .groupBy("split", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


__all__ = ["in_split", "seeded_order", "split_assign", "split_label_counts",
           "split_summary", "SPLIT_SEED"]
