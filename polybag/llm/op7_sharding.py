"""Put documents into shards of near equal bytes by differencing (Karmarkar and Karp).

Documents of equal text form a group that is never cut.  Every group starts as a partition with
one used slot; the two partitions of largest spread are combined again and again, the fullest
slot of one upon the emptiest of the other.  At scale this runs in levels: groups are hashed into
pieces, each piece is differenced in a task of its own, and the pieces' slot sums are differenced
in turn, some hundred at a time, until one partition is left.

A null text is a group of its own (16 bytes a row), an empty text another one; repeated rows are
rows like others; an empty table gives none.  The law that holds is ``bytes``: a group larger
than a shard's share makes its shard that much larger, and nothing else can be done about it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole
from polybag.session import saved, ship_package

SHARDS = 40
OVERHEAD = 16
# Groups that one task differences; pieces that the next level combines.
PIECE = 2_000
FAN_IN = 256
# Rows numbered by one window task, on average.
RUN = 10_000


def difference(sums: np.ndarray) -> np.ndarray:
    """Combine partitions, a row of slot sums each, to one; where each of their slots goes.

    Ties in spread go to the earlier partition, ties in a slot's sum to the earlier slot.
    """
    n, parts = sums.shape
    home = np.empty((n, parts), dtype=np.int64)
    if not n:
        return home
    orders = np.argsort(sums, axis=1, kind="stable")
    state = {i: sums[i][order] for i, order in enumerate(orders)}
    heap = [(float(s[0] - s[-1]), i) for i, s in state.items()]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = state.pop(a) + state.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        state[fresh] = total[order]
        joins.append((a, b, order))
        heapq.heappush(heap, (float(state[fresh][0] - state[fresh][-1]), fresh))
        fresh += 1
    # From the last partition back: which final slot each sorted slot of a partition ends in.
    ends = {fresh - 1: np.arange(parts)}
    for k in range(len(joins) - 1, -1, -1):
        a, b, order = joins[k]
        final = ends.pop(n + k)
        place = np.empty(parts, dtype=np.int64)
        place[order] = final
        ends[a], ends[b] = place, place[::-1]
    for i, order in enumerate(orders):
        home[i, order] = ends[i]
    return home


def _difference_groups(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ignore_index=True)
        sums = np.zeros((len(pdf), shards))
        sums[:, -1] = pdf["bytes"]
        return pdf[["key", "piece"]].assign(slot=difference(sums)[:, -1].astype("int32"))
    return run


def _difference_pieces(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, row = np.unique(pdf["piece"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(pieces), shards))
        sums[row, pdf["slot"].to_numpy()] = pdf["bytes"]
        home = difference(sums)
        return pd.DataFrame({
            "piece": np.repeat(pieces, shards), "slot": np.tile(np.arange(shards, dtype="int32"), len(pieces)),
            "parent": pdf["parent"].iloc[0], "up": home.ravel().astype("int32")})
    return run


def group_shards(groups: DataFrame, shards: int = SHARDS, piece: int = PIECE,
                 fan_in: int = FAN_IN) -> DataFrame:
    """(key, bytes) rows of groups to (key, shard)."""
    ship_package(groups.sparkSession)
    pieces = max(1, math.ceil(groups.count() / piece))
    hashed = groups.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(pieces)))
    placed = saved(hashed.groupBy("piece").applyInPandas(
        _difference_groups(shards), "key string, piece bigint, slot int"), "pieces")
    sums = placed.join(groups, "key").groupBy("piece", "slot").agg(F.sum("bytes").alias("bytes"))
    current = placed.withColumnRenamed("slot", "shard")
    while pieces > 1:
        pieces = math.ceil(pieces / fan_in)
        raised = saved(
            sums.withColumn("parent", F.pmod(F.xxhash64("piece"), F.lit(pieces))).groupBy("parent")
            .applyInPandas(_difference_pieces(shards), "piece bigint, slot int, parent bigint, up int"),
            "levels")
        sums = sums.join(raised, ["piece", "slot"]).groupBy(
            F.col("parent").alias("piece"), F.col("up").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        current = current.join(
            raised.withColumnRenamed("slot", "shard"), ["piece", "shard"]).select(
            "key", F.col("parent").alias("piece"), F.col("up").alias("shard"))
    return current.select("key", "shard")


def _key(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("null"))


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def shard_rows(docs: DataFrame, shards: int = SHARDS, piece: int = PIECE,
               run: int = RUN) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every row; texts don't move.

    Slots number a shard's rows in runs that are cut by a hash, so that no task numbers a whole
    shard; a run starts where the counts of those before it end.
    """
    text = F.col("text")
    base = saved(docs.select(
        "doc_id", _bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        _key(text).alias("key")), "sizes")
    groups = saved(base.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    runs = max(1, math.ceil(base.count() / shards / run))
    placed = saved(base.join(group_shards(groups, shards, piece), "key").withColumn(
        "run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs))), "placed")
    counts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("place", F.row_number().over(inside) - 1).join(
        starts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "key", "shard",
        (F.col("start") + F.col("place")).alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents with the shard of their text; ``shard`` is the last column.

    A column of that name is replaced.  Writing it with ``partitionBy("shard")`` gives the files.
    """
    text = F.col("text")
    sizes = saved(docs.select(_bytes(text).alias("size"), _key(text).alias("key")).groupBy("key").agg(
        F.sum("size").alias("bytes")), "groups")
    rows = kept_whole(docs, _key(text).alias("key"))
    own = [f"{ROW}.`{name}`" for name in docs.columns if name.lower() != "shard"]
    return rows.join(group_shards(sizes, shards), "key").select(*own, "shard")
