"""Ranks and joins that hold when one key owns a large share of all rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.functions import hash_key
from polybag.session import saved

# A key with more rows than this is split over several tasks.
HEAVY_ROWS = 1_000_000
# A longer list of heavy keys is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000
LISTED_ROWS = 1_000
# Pieces a hash order is cut into at least, as hex digits, for the sake of parallel work.
LEAST_DIGITS = 3


class Heavy(NamedTuple):
    """The heavy keys of a table: ``frame(key, key_rows)``, or None if there are none."""

    frame: DataFrame | None
    rows: int
    broadcast: bool = True

    def join(self, rows: DataFrame, key: str, how: str) -> DataFrame:
        """Add ``key_rows``; NULL is a key like others.

        A broadcast list was counted when it was found.  A longer one is joined by a shuffle: its
        keys are then a small part of the rows each, though above the threshold.
        """
        listed = self.frame.withColumnRenamed(key, "_listed")
        return rows.join(F.broadcast(listed) if self.broadcast else listed,
                         F.col(key).eqNullSafe(F.col("_listed")), how).drop("_listed")


def find_heavy(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS,
               limit: int = BROADCAST_ROWS) -> Heavy:
    """Find the keys with more than ``heavy_rows`` rows.

    One aggregate, combined before the shuffle, whose result has at most ``rows / heavy_rows``
    rows; their number decides the plan.  Without any, the operators use the plain window or
    join.  A short list is kept in the plan, a longer one is written.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    found = counts.where(F.col("key_rows") > heavy_rows)
    few = found.limit(min(LISTED_ROWS, limit) + 1).collect()
    if not few:
        return Heavy(None, heavy_rows)
    if len(few) <= min(LISTED_ROWS, limit):
        return Heavy(df.sparkSession.createDataFrame(few, found.schema), heavy_rows)
    found = saved(found, "heavy")
    return Heavy(found, heavy_rows, found.count() <= limit)


def _hex_digits(rows: Column, heavy_rows: int) -> Column:
    """How many hex digits of a hash cut ``rows`` into pieces of about ``heavy_rows``."""
    steps = [F.lit(heavy_rows).cast("double") * 16.0**d for d in range(1, 9)]
    digits = F.lit(1)
    for limit in steps:
        digits = digits + (rows > limit).cast("int")
    return digits


def hashed_rank(df: DataFrame, key: str, rank: str = "rank", total: str | None = None,
                seed: int | str = "", digits: int | None = None,
                piece_rows: int = HEAVY_ROWS) -> DataFrame:
    """0-based position of each row in md5 order of ``seed:key`` (ties broken by ``key``).

    Same result as ``row_number()`` over the whole table, without the single task that needs:
    the leading hex digits cut the order into ``16**digits`` even pieces, rows are numbered
    within a piece, and the start of each piece is a prefix sum over one small row per piece.
    Unless given, ``digits`` follows from the number of rows: no piece has more than about
    ``piece_rows`` of them.  The order is the same for any number of pieces.
    """
    if digits is None:
        rows = df.select(key).count()
        digits = LEAST_DIGITS
        while rows > piece_rows * 16**digits:
            digits += 1
    h = hash_key(seed, F.col(key))
    keyed = df.withColumn("_h", h).withColumn("_piece", F.substring("_h", 1, digits))
    sizes = (
        df.select(F.substring(h, 1, digits).alias("_piece"))
        .groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    # One row per piece, at most 16 per ``piece_rows`` rows, so one task and a broadcast do.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "_piece",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_piece").orderBy("_h", key)
    ranked = (
        keyed.withColumn("_in", F.row_number().over(inside))
        .join(F.broadcast(starts), "_piece")
        .withColumn(rank, (F.col("_start") + F.col("_in") - 1).cast("bigint"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("bigint"))
    return ranked.drop("_h", "_piece", "_start", "_in", "_total")


def sorted_rank(df: DataFrame, *order: str, rank: str = "rank",
                total: str | None = None) -> DataFrame:
    """0-based position of each row in the sort order of ``order`` (unique together).

    Range-partitioned sort; a row's place is its place inside the partition plus the sizes of
    the partitions before it.  The sorted rows are written once, because the cut points of a
    range partitioning are sampled and both the sizes and the places must use the same ones.
    """
    placed = saved(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "sorted",
    )
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(rank, (F.col("_start") + inside).cast("bigint"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("bigint"))
    return ranked.drop("_place", "_part", "_start", "_total")


def _heavy_starts(df: DataFrame, group: str, h: Column, heavy: Heavy) -> DataFrame:
    """(group, _piece, _start, _size): where each piece of a heavy group begins."""
    pieces = (
        _cut(heavy.join(df.select(group, h.alias("_h")), group, "inner"), heavy)
        .groupBy(group, "_piece")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    # A heavy group has at most 16 pieces per heavy_rows rows.
    by_group = Window.partitionBy(group).orderBy("_piece")
    return pieces.select(
        group,
        "_piece",
        F.coalesce(F.sum("_rows").over(
            by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_rows").over(by_group.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size"),
    )


def _cut(rows: DataFrame, heavy: Heavy) -> DataFrame:
    """The leading hex digits of ``_h`` as ``_piece``, empty for usual groups."""
    digits = F.when(F.col("key_rows").isNotNull(), _hex_digits(F.col("key_rows"), heavy.rows))
    return rows.withColumn("_piece", F.substring(
        F.col("_h"), F.lit(1), F.coalesce(digits, F.lit(0)))).drop("key_rows")


def rank_within(df: DataFrame, group: str, key: str, rank: str = "rank", total: str = "n",
                seed: int | str = "", heavy_rows: int = HEAVY_ROWS,
                heavy: Heavy | None = None) -> DataFrame:
    """0-based position of each row in its group, in md5 order of ``seed:key``, and group size.

    Groups of usual size are numbered by one window.  A heavy group is first cut by the leading
    hex digits of the hash, so that no task holds more than about ``heavy_rows`` of its rows;
    the pieces' starting points come from their counts.  ``heavy`` may hand in the heavy keys
    of a table that contains ``df``.
    """
    heavy = heavy or find_heavy(df, group, heavy_rows)
    h = hash_key(seed, F.col(key))
    keyed = df.withColumn("_h", h)
    groups = [group]
    if heavy.frame is not None:
        keyed = _cut(heavy.join(keyed, group, "left"), heavy)
        groups = [group, "_piece"]
    inside = Window.partitionBy(*groups).orderBy("_h", key)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = (
        keyed.withColumn(rank, (F.row_number().over(inside) - 1).cast("bigint"))
        .withColumn(total, F.count(F.lit(1)).over(whole))
        .drop("_h")
    )
    if heavy.frame is None:
        return numbered
    starts = _heavy_starts(df, group, h, heavy).withColumnsRenamed(
        {group: "_owner", "_piece": "_part"})
    return (
        numbered.join(starts, F.col(group).eqNullSafe(F.col("_owner"))
                      & (F.col("_piece") == F.col("_part")), "left")
        .withColumn(rank, F.col(rank) + F.coalesce("_start", F.lit(0)))
        .withColumn(total, F.coalesce("_size", total))
        .drop("_piece", "_start", "_size", "_owner", "_part")
    )


def spread_join(rows: DataFrame, unique: DataFrame, key: str, spread_by: str,
                how: str = "inner", heavy_rows: int = HEAVY_ROWS,
                heavy: Heavy | None = None) -> DataFrame:
    """``rows`` N:1 ``unique`` on ``key``; heavy keys of ``rows`` are salted.

    The matching row of a heavy key is copied once per salt, one copy per ``heavy_rows`` rows,
    so the copies number at most twice ``rows / heavy_rows`` in all.
    """
    heavy = heavy or find_heavy(rows, key, heavy_rows)
    if heavy.frame is None:
        return rows.join(unique, key, how)
    ways = F.coalesce(F.ceil(F.col("key_rows") / heavy.rows).cast("int"), F.lit(1))
    left = heavy.join(rows, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(F.col(spread_by)), ways).cast("int")).drop("key_rows")
    right = heavy.join(unique, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("key_rows")
    return left.join(right, [key, "_salt"], how).drop("_salt")
