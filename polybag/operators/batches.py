"""Batches of bags: assignment, statistics, offsets, balanced halves."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polybag.operators.skew import hashed_rank, sorted_rank
from polybag.operators.splits import SPLIT_SEED
from polybag.session import map_pandas, saved


def assign_batches(bags: DataFrame, batch_size: int, order: str = "lexical",
                   key: str = "bag_id", seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``batch_id`` and ``pos``; the last partial batch is dropped.

    ``order="lexical"`` walks the ids as text (``g_10`` before ``g_2``), ``"shuffled"`` in
    seeded hash order.
    """
    if order == "lexical":
        ranked = sorted_rank(bags, key, rank="_r", total="_n")
    elif order == "shuffled":
        ranked = hashed_rank(bags, key, rank="_r", total="_n", seed=seed)
    else:
        raise ValueError(f"unknown order: {order}")
    return (
        ranked.withColumn("batch_id", F.expr(f"_r div {int(batch_size)}"))
        .withColumn("pos", (F.col("_r") % batch_size).cast("int"))
        .where(F.col("_r") < F.col("_n") - F.col("_n") % batch_size)
        .drop("_r", "_n")
    )


def batch_stats(batched: DataFrame) -> DataFrame:
    """Bags, instances and longest bag of each batch."""
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_bags"),
        F.sum("nslice").alias("n_instances"),
        F.max("nslice").alias("max_slice"),
    )


def segment_offsets(batched: DataFrame) -> DataFrame:
    """Where each bag's instances start in the flattened batch."""
    before = (Window.partitionBy("batch_id").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, -1))
    return batched.withColumn("offset", F.coalesce(F.sum("nslice").over(before), F.lit(0)))


def halves(sizes: list[int]) -> list[int]:
    """Indices of the best half followed by the rest, for one small batch.

    Exact: among all choices of ``len//2`` bags whose sizes sum to at most half the total,
    the sum is the largest possible.  Later bags are preferred on ties.
    """
    n, limit = len(sizes), sum(sizes) // 2
    mask = (1 << (limit + 1)) - 1
    # reachable[i][j]: bit v is set when j of the first i sizes can sum to v.
    reachable = [[1] + [0] * (n // 2)]
    for size in sizes:
        row = reachable[-1]
        reachable.append(
            [1] + [row[j] | ((row[j - 1] << size) & mask) for j in range(1, n // 2 + 1)])
    wanted, left = n // 2, reachable[n][n // 2].bit_length() - 1
    picked = []
    for i in range(n, 0, -1):
        if wanted and left >= sizes[i - 1] and (
                reachable[i - 1][wanted - 1] >> (left - sizes[i - 1])) & 1:
            picked.append(i - 1)
            wanted, left = wanted - 1, left - sizes[i - 1]
    chosen = set(picked)
    return picked + [i for i in range(n) if i not in chosen]


def _balance(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    for pdf in batches:
        orders = [halves([int(s) for s in sizes]) for sizes in pdf["_sizes"]]
        yield pd.DataFrame({
            "batch_id": pdf["batch_id"],
            "_ids": [[ids[i] for i in order] for ids, order in zip(pdf["_ids"], orders)],
            "_sizes": [[int(s[i]) for i in order] for s, order in zip(pdf["_sizes"], orders)],
        })


def balance_batches(batched: DataFrame, key: str = "bag_id") -> DataFrame:
    """Reorder each batch so that its two halves carry nearly equal instance counts.

    A batch is one small row (``batch_size`` ids and sizes), so many batches share one Arrow
    transfer instead of one Python call per group.  ``half`` is 0 for the picked bags.
    """
    entries = F.sort_array(F.collect_list(F.struct("pos", key, "nslice")))
    packed = batched.groupBy("batch_id").agg(entries.alias("_e")).select(
        "batch_id",
        F.transform("_e", lambda e: e[key]).alias("_ids"),
        F.transform("_e", lambda e: e["nslice"].cast("int")).alias("_sizes"),
    )
    id_type = batched.schema[key].dataType.simpleString()
    done = map_pandas(
        packed, _balance, f"batch_id bigint, _ids array<{id_type}>, _sizes array<int>")
    return done.select(
        "batch_id",
        F.size("_ids").alias("_n"),
        F.posexplode(F.arrays_zip("_ids", "_sizes")).alias("pos", "_e"),
    ).select(
        "batch_id",
        "pos",
        F.col("_e._ids").alias(key),
        F.col("_e._sizes").alias("nslice"),
        (F.col("pos") >= F.expr("_n div 2")).cast("int").alias("half"),
    )


def collate(batched: DataFrame, max_bag: int, per_instance: bool = True) -> tuple[DataFrame, DataFrame]:
    """(instances, bags) of each batch as a model takes them.

    ``batched`` has (batch_id, pos, bag_id, images, nslice, gt).  Bags are reordered to balanced
    halves and their true instances packed in front: ``row_no`` runs from 0 to
    ``max_bag * bags - 1``, and rows beyond the last instance have no path and a zero annotation.
    ``per_instance`` repeats a bag's annotation on its instances, as training wants it; else only
    ``bags`` (batch_id, pos, bag_id, nslice, offset, gt) carries it, which evaluation regroups by.
    """
    # The order is found once; both results read it, and only instances need the image lists.
    order = saved(segment_offsets(balance_batches(batched)).select(
        "batch_id", "pos", "bag_id", "nslice", "offset"), "balanced")
    bags = order.join(batched.select("batch_id", "bag_id", "gt"), ["batch_id", "bag_id"])
    packed = order.select("batch_id", "bag_id", "offset").join(
        batched.select("batch_id", "bag_id", "images", "gt"), ["batch_id", "bag_id"]).select(
        "batch_id", "offset", "bag_id", "gt", F.posexplode("images").alias("at", "path"))
    zeros = F.transform(F.first("gt"), lambda _: F.lit(0))
    sizes = batched.groupBy("batch_id").agg(
        F.sum("nslice").cast("bigint").alias("used"),
        (F.count(F.lit(1)) * max_bag).alias("rows"), zeros.alias("gt"))
    empty = F.when(F.col("used") < F.col("rows"), F.sequence(F.col("used"), F.col("rows") - 1))
    tail = sizes.select("batch_id", F.explode(empty).alias("row_no"), F.lit(None).cast("string").alias("bag_id"),
                        F.lit(None).cast("string").alias("path"), "gt")
    instances = packed.select(
        "batch_id", (F.col("offset") + F.col("at")).cast("bigint").alias("row_no"), "bag_id", "path", "gt"
    ).unionByName(tail)
    return (instances if per_instance else instances.drop("gt"),
            bags.select("batch_id", "pos", "bag_id", "nslice", "offset", "gt"))
