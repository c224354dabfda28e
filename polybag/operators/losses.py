"""Binary cross-entropy, and the in-batch contrastive loss over three views.

Views come as a long table ``(batch_id, sample_id, view, embedding)`` with views x, y, z.

The contrastive terms need, per anchor, the similarity to its own sample and the sum over the
batch's other samples.  Rows of a batch are packed in blocks of at most ``block`` samples; one
Arrow row holds one pair of blocks and NumPy multiplies the two matrices, so pairs of samples
never become rows and a batch larger than a block is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.functions import l2_normalize
from polybag.operators.skew import spread_join
from polybag.session import map_arrow, saved

TEMPERATURE = 0.1
BLOCK = 512
PROBABILITY_FLOOR = 1e-12
VIEWS = ("x", "y", "z")
# Similarity matrices: (anchor view, other view).
MATRICES = [("x", "x"), ("y", "y"), ("x", "y"), ("x", "z"), ("y", "z"), ("z", "x"), ("z", "y")]


# ---------------------------------------------------------------- cross-entropy

def bce_terms(cells: DataFrame, score: str = "score", target: str = "gt",
              weight: str | None = None, out: str = "bce") -> DataFrame:
    """Reduction "none": ``-w (y ln x + (1 - y) ln(1 - x))`` per cell, x kept off 0 and 1."""
    x = F.greatest(F.least(F.col(score), F.lit(1.0 - PROBABILITY_FLOOR)),
                   F.lit(PROBABILITY_FLOOR))
    y = F.col(target).cast("double")
    w = F.col(weight) if weight else F.lit(1.0)
    return cells.withColumn(out, -w * (y * F.ln(x) + (1 - y) * F.ln(1 - x)))


def bce_loss(cells: DataFrame, reduction: str = "mean", score: str = "score",
             target: str = "gt", weight: str | None = None) -> DataFrame:
    """Cross-entropy with reduction "none", "mean" or "sum"."""
    terms = bce_terms(cells, score, target, weight)
    if reduction == "none":
        return terms
    reduce = {"mean": F.avg, "sum": F.sum}[reduction]
    return terms.agg(reduce("bce").alias("bce"))


# ---------------------------------------------------------------- views

def normalize_views(views: DataFrame) -> DataFrame:
    """Unit-length embeddings."""
    return views.withColumn("embedding", l2_normalize("embedding"))


def align_views(views: DataFrame) -> DataFrame:
    """One row per (batch, sample) with columns x, y, z: one aggregate instead of two joins.

    Samples lacking a view are dropped.
    """
    columns = [F.any_value(F.when(F.col("view") == v, F.col("embedding")), True).alias(v)
               for v in VIEWS]
    aligned = views.groupBy("batch_id", "sample_id").agg(*columns)
    return aligned.dropna(subset=list(VIEWS))


def stack_views(aligned: DataFrame) -> DataFrame:
    """The opposite: one row per view."""
    entries = F.array(*[
        F.struct(F.lit(v).alias("view"), F.col(v).alias("embedding")) for v in VIEWS])
    return aligned.select("batch_id", "sample_id", F.explode(entries).alias("_v")).select(
        "batch_id", "sample_id", "_v.view", "_v.embedding")


# ---------------------------------------------------------------- similarities

def _matrix(column: pa.Array, row: int, ids: int) -> np.ndarray:
    """The flattened vectors of one block as an (ids, d) matrix."""
    return column[row].values.to_numpy(zero_copy_only=False).reshape(ids, -1)


def _block_sums(temperature: float):
    names = [f"{a}{b}" for a, b in MATRICES]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            parts = []
            for row in range(batch.num_rows):
                ids = col["a_ids"][row].values
                n_a = len(ids)
                same = col["same"][row].as_py()
                other = "a" if same else "b"
                n_b = len(col[other + "_ids"][row].values)
                sides = {}
                for v in VIEWS:
                    sides["a" + v] = _matrix(col["a_" + v], row, n_a)
                    sides["b" + v] = _matrix(col[f"{other}_{v}"], row, n_b)
                values = []
                for a, b in MATRICES:
                    s = np.exp(sides["a" + a] @ sides["b" + b].T / temperature)
                    own = np.diagonal(s).copy() if same else np.zeros(n_a)
                    if same:
                        np.fill_diagonal(s, 0.0)
                    values += [pa.array(own), pa.array(s.sum(axis=1))]
                key = pa.repeat(col["batch_id"][row], n_a)
                others = pa.array(np.full(n_a, n_b - int(same), dtype=np.int64))
                parts.append(pa.RecordBatch.from_arrays(
                    [key, ids, others, *values],
                    names=["batch_id", "sample_id", "others"]
                    + [f"{n}_{k}" for n in names for k in ("own", "rest")]))
            yield from parts

    return run


def _field(name: str):
    return lambda entry: entry[name]


def _blocks(views: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """Packed blocks ``(batch_id, block, blocks, ids, x, y, z)``, and whether a batch has several.

    The batches are counted first.  With none above the block size (the usual case) the views
    are shuffled once, by batch, and both aligned and packed there.  Otherwise a large batch is
    cut into a number of blocks that follows from its row count; its samples are dealt out by
    hash, so a block holds half of ``block`` on average.
    """
    counts = views.where(F.col("view") == VIEWS[0]).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("_n"))
    large = saved(counts.where(F.col("_n") > block), "large")
    several = not large.isEmpty()
    if several:
        dealt = spread_join(
            align_views(views), large, "batch_id", "sample_id", "left"
        ).withColumn(
            "blocks", F.coalesce(F.ceil(F.col("_n") * 2 / block).cast("int"), F.lit(1))
        ).withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"))
    else:
        dealt = align_views(views.repartition("batch_id")).withColumn(
            "blocks", F.lit(1)).withColumn("block", F.lit(0))
    entry = F.struct("sample_id", *[F.col(v).cast("array<double>").alias(v) for v in VIEWS])
    packed = dealt.groupBy("batch_id", "block", "blocks").agg(
        F.sort_array(F.collect_list(entry)).alias("_e"))
    return packed.select(
        "batch_id", "block", "blocks",
        F.transform("_e", lambda e: e["sample_id"]).alias("ids"),
        *[F.flatten(F.transform("_e", _field(v))).alias(v) for v in VIEWS]), several


def anchor_similarities(views: DataFrame, temperature: float = TEMPERATURE,
                        block: int = BLOCK) -> DataFrame:
    """Per anchor and matrix: ``ab_own`` = s[i,i] and ``ab_rest`` = sum over j<>i of s[i,j].

    s[i,j] = exp(a_i . b_j / temperature) within the batch.  ``others`` counts the j<>i.
    """
    packed, several = _blocks(views, block)
    left = packed.select("batch_id", F.col("block").alias("a_block"),
                         F.col("ids").alias("a_ids"),
                         *[F.col(v).alias(f"a_{v}") for v in VIEWS],
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b_block"))
    met = left.select("*", F.lit(True).alias("same"))
    if several:
        # An equi-join on (batch, block): each pair of blocks meets exactly once.
        right = packed.where(F.col("blocks") > 1).select(
            "batch_id", F.col("block").alias("b_block"), F.col("ids").alias("b_ids"),
            *[F.col(v).alias(f"b_{v}") for v in VIEWS])
        same = F.col("a_block") == F.col("b_block")
        met = left.join(right, ["batch_id", "b_block"], "left").where(
            same | F.col("b_ids").isNotNull()).withColumn("same", same)
    met = met.drop("a_block", "b_block")
    names = [f"{a}{b}" for a, b in MATRICES]
    keys = {c: views.schema[c].dataType.simpleString() for c in ("batch_id", "sample_id")}
    schema = ", ".join(
        [f"{c} {t}" for c, t in keys.items()] + ["others bigint"]
        + [f"{n}_{k} double" for n in names for k in ("own", "rest")])
    sums = map_arrow(met, _block_sums(temperature), schema)
    if not several:
        return sums
    return sums.groupBy("batch_id", "sample_id").agg(
        F.sum("others").alias("others"),
        *[F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in names for k in ("own", "rest")])


def similarity_rows(similarities: DataFrame) -> DataFrame:
    """Long form: (batch_id, sample_id, matrix, own, rest)."""
    entries = F.array(*[
        F.struct(F.lit(a + b).alias("matrix"), F.col(f"{a}{b}_own").alias("own"),
                 F.col(f"{a}{b}_rest").alias("rest"))
        for a, b in MATRICES])
    return similarities.select("batch_id", "sample_id", F.explode(entries).alias("_m")).select(
        "batch_id", "sample_id", "_m.*")


# ---------------------------------------------------------------- contrastive loss

def _alone(term: Column) -> Column:
    """NULL for a batch of one sample, which has no other sample to compare with."""
    return F.when(F.col("others") > 0, term)


def _mutual() -> Column:
    # The positive pair itself is not in the denominator, so the term may be negative.
    rest = F.col("xy_rest") + F.col("xx_rest") + F.col("yy_rest")
    return _alone(-2 * F.ln(F.try_divide(F.col("xy_own"), rest)))


def _aux(matrix: str) -> Column:
    return _alone(-F.ln(F.try_divide(F.col(f"{matrix}_own"), F.col(f"{matrix}_rest"))))


AUX_TERMS = {"aux_x": "xz", "aux_y": "yz", "aux_z_x": "zx", "aux_z_y": "zy"}


def contrastive_terms(similarities: DataFrame) -> DataFrame:
    """Mean term per batch: mutual, and the four against the auxiliary view."""
    return similarities.groupBy("batch_id").agg(
        F.avg(_mutual()).alias("mutual"),
        *[F.avg(_aux(m)).alias(name) for name, m in AUX_TERMS.items()])


def contrastive_loss(similarities: DataFrame) -> DataFrame:
    """The terms and their sum per batch."""
    total = F.col("mutual")
    for name in AUX_TERMS:
        total = total + F.col(name)
    return contrastive_terms(similarities).withColumn("loss", total)
