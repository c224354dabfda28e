"""Mix sources to target weights by repeating documents.

Words are summed per source; a source's share of all words follows its weight, but no target
exceeds ``cap`` times the source.  A document is emitted ``floor(rate)`` times, and once more if
a number hashed from its id falls below the rest of the rate.

Null texts have no words, a null source is a source of its own and comes last, repeated rows are
drawn alike, documents without words go like others (their copies take nothing), and an empty
table stays empty.  A document's own columns are never read beyond ``doc_id, text, source``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.functions import hash_uniform
from polybag.llm.common import ROW, kept_whole, n_words, text_of, unwrapped
from polybag.operators.skew import sorted_rank
from polybag.session import saved

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 20240229


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size) rows to (source, source_size, target, rate), one row per source.

    The level is the number of words per unit of weight.  Each round fixes the sources that the
    level would lift above their cap and deals the rest of the words over the others; the level
    only rises, so a round that fixes no further source is the last.  Only three sums per round
    come to the driver, whatever the number of sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = sorted_rank(sums.withColumn("_last", F.col("source").isNull()), "_last", "source",
                         rank="place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))),
                          (F.col("place") % len(weights) + 1).cast("int"))
    plan = saved(placed.select("source", "source_size", weight.alias("weight"),
                               (F.col("source_size") * cap).alias("ceiling")), "mix")
    level, fixed = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("ceiling")
        row = plan.agg(
            F.sum("source_size").alias("total"), F.count_if(above).alias("fixed"),
            F.sum(F.when(above, F.col("ceiling")).otherwise(0.0)).alias("spent"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row.total or not row.weight or row.fixed == fixed:
            break
        level, fixed = (row.total - row.spent) / row.weight, row.fixed
    target = F.least(F.col("weight") * level, F.col("ceiling"))
    return plan.select(
        "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
        .alias("rate"))


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP,
           seed: int = SEED) -> DataFrame:
    """Each row as a struct, with ``size, source_size, target, copies``.

    The table of sources joins by its size: broadcast while Spark's threshold allows it.
    """
    size = n_words(text_of())
    plan = targets(docs.select("source", size.alias("size")), weights, cap)
    rows = kept_whole(docs, F.col("source").alias("_source"), size.alias("size"),
                      hash_uniform(seed, F.col("source"), F.col("doc_id")).alias("_draw"))
    rate = F.floor("rate")
    return rows.join(plan, rows["_source"].eqNullSafe(plan["source"]), "left").select(
        ROW, "size", "source_size", "target",
        (rate + (F.col("_draw") < F.col("rate") - rate).cast("int")).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP,
        seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document as often as it is drawn, with its own columns."""
    drawn = copies(docs, weights, cap, seed)
    repeated = drawn.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return unwrapped(repeated)


def mix_digest(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    return copies(docs).select(
        f"{ROW}.doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))
