"""Exact area under the ROC curve, with ties, for any number of scores.

AUC = sum over positives of (negatives scored below + half the negatives tied) / (P * N).

1. Cells are counted per (label, score): ties become one row, combined before the shuffle.
2. The counts are range-partitioned by score.  A score has at most one row per label, so the
   partitions are even however concentrated the scores are.
3. Each partition walks its rows once and returns, per label and for all labels pooled, its
   P, N and the pair sum within itself.
4. These pieces are few (partitions x labels); one more prefix sum over them adds the pairs
   between pieces.

Only one branch reads the range-partitioned rows, so a retry with other cut points cannot mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polybag.operators.metrics import outcome_cells, term_sums
from polybag.session import map_pandas

# The label index under which all labels together are reported.
POOLED = -1


def score_cells(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label_idx, gt, score) rows of the evaluated table."""
    return evaluated.select(
        *by, F.posexplode(F.arrays_zip("gt", "scores")).alias("label_idx", "_c")
    ).select(*by, "label_idx", F.col("_c.gt").alias("gt"), F.col("_c.scores").alias("score"))


def score_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each label at each distinct score."""
    return cells.groupBy(*by, "label_idx", "score").agg(
        F.sum("gt").cast("bigint").alias("pos"),
        F.sum(1 - F.col("gt")).cast("bigint").alias("neg"),
    )


def outcome_counts(evaluated: DataFrame, by: Sequence[str] = (),
                   decimals: int | None = None) -> DataFrame:
    """Positives and negatives per (by, label, score, prediction), and the example terms.

    Confusion counts, example means and AUC all follow from this one table, in batch and as the
    state of a stream.  ``decimals`` rounds the scores, which bounds the table and blurs the AUC.
    """
    score = F.col("_c.scores")
    return outcome_cells(evaluated, by, ["scores"]).groupBy(
        *by, "label_idx",
        (score if decimals is None else F.round(score, decimals)).alias("score"),
        F.col("_c.pred").alias("pred"),
    ).agg(
        F.sum(F.col("_c.gt")).cast("bigint").alias("pos"),
        F.sum(1 - F.col("_c.gt")).cast("bigint").alias("neg"),
        *term_sums(),
    )


def confusion_of(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the example terms per label from :func:`outcome_counts`."""
    def total(column: str, pred: int):
        return F.sum(F.when(F.col("pred") == pred, F.col(column)).otherwise(0))

    return outcomes.groupBy(*by, "label_idx").agg(
        total("pos", 1).alias("tp"), total("neg", 1).alias("fp"),
        total("neg", 0).alias("tn"), total("pos", 0).alias("fn"), *term_sums())


def areas_of(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and micro AUC from :func:`outcome_counts`, or from several such tables put together.

    Rows of a score are brought together by the one move that ranks the scores.
    """
    ranged = outcomes.select(*by, "label_idx", "score", "pos", "neg").repartitionByRange(*by, "score")
    merged = ranged.groupBy(*by, "label_idx", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _areas(_auc_of_ranges(merged, by), by)


class _Tally:
    """Running P, N and pair sums of one key group inside a partition."""

    def __init__(self, key: tuple):
        self.key = key
        self.labels: dict[int, list[float]] = {}
        self.tied = None  # the last score with its pooled pos and neg, still open

    def _add(self, label: int, first: float, pos: np.ndarray, neg: np.ndarray) -> None:
        total = self.labels.setdefault(label, [first, 0, 0, 0.0])
        below = total[2] + np.cumsum(neg) - neg
        total[3] += float(np.dot(pos.astype(np.float64), below + neg / 2.0))
        total[1] += int(pos.sum())
        total[2] += int(neg.sum())

    def add(self, labels: np.ndarray, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows in score order."""
        order = np.argsort(labels, kind="stable")
        found, starts = np.unique(labels[order], return_index=True)
        for label, at in zip(found, np.split(order, starts[1:])):
            self._add(int(label), float(score[at[0]]), pos[at], neg[at])
        # Pooled: rows of equal score count as one, also across the edge of an Arrow batch.
        if self.tied is not None:
            score, pos, neg = (np.concatenate([[t], a]) for t, a in zip(
                self.tied, (score, pos, neg)))
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        if len(starts) > 1:
            self._add(POOLED, float(score[0]), pos[:-1], neg[:-1])
        self.tied = (score[-1], pos[-1], neg[-1])

    def pieces(self) -> list[tuple]:
        score, pos, neg = self.tied
        self._add(POOLED, float(score), np.array([pos]), np.array([neg]))
        return [(*self.key, label, *total) for label, total in self.labels.items()]


def _piece_sums(by: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]:
    columns = [*by, "label_idx", "first_score", "p", "n", "pairs"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        tally, done = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            # Rows are sorted by the keys first: cut the batch where a key changes.
            changed = np.zeros(len(pdf), dtype=bool)
            for c in by:
                changed[1:] |= pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1]
            cuts = [0, *np.flatnonzero(changed), len(pdf)]
            arrays = [pdf[c].to_numpy() for c in ("label_idx", "score", "pos", "neg")]
            for start, end in zip(cuts[:-1], cuts[1:]):
                key = tuple(pdf[c].iloc[start] for c in by)
                if tally is None or key != tally.key:
                    if tally is not None:
                        done += tally.pieces()
                    tally = _Tally(key)
                tally.add(*(a[start:end] for a in arrays))
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=columns)
                done = []
        if tally is not None:
            yield pd.DataFrame(done + tally.pieces(), columns=columns)

    return run


def auc_per_label(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label_idx, p, n, auc) for every label and, as label -1, for all labels pooled.

    ``counts`` has (by, label_idx, score, pos, neg), one row per score.  AUC is NULL when one
    class is missing.
    """
    return _auc_of_ranges(counts.repartitionByRange(*by, "score"), by)


def _auc_of_ranges(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same for counts that are range-partitioned by score."""
    by = list(by)
    schema = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in by)
    pieces = map_pandas(
        counts.sortWithinPartitions(*by, "score")
        .select(*by, "label_idx", "score", "pos", "neg"),
        _piece_sums(by),
        f"{schema + ', ' if by else ''}label_idx int, first_score double, p bigint, n bigint, "
        "pairs double")
    before = (Window.partitionBy(*by, "label_idx").orderBy("first_score")
              .rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.sum("n").over(before), F.lit(0))
    possible = F.col("p").cast("double") * F.col("n")
    return (
        pieces.withColumn("_below", below)
        .groupBy(*by, "label_idx")
        .agg(
            F.sum("p").alias("p"),
            F.sum("n").alias("n"),
            F.sum(F.col("pairs") + F.col("p").cast("double") * F.col("_below")).alias("pairs"),
        )
        .select(*by, "label_idx", "p", "n",
                F.when(possible > 0, F.col("pairs") / possible).alias("auc"))
    )


def _areas(per_label: DataFrame, by: Sequence[str]) -> DataFrame:
    label = F.col("label_idx") >= 0
    undefined = F.sum((label & F.col("auc").isNull()).cast("int")) > 0
    return per_label.groupBy(*by).agg(
        F.when(undefined, F.lit(-1.0)).otherwise(F.avg(F.when(label, F.col("auc"))))
        .alias("sk_auc_macro"),
        F.max(F.when(~label, F.col("auc"))).alias("sk_auc_micro"),
    )


def auc_macro(per_label: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over labels; -1 for the whole value if any label has a single class."""
    return _areas(per_label, by).drop("sk_auc_micro")


def auc_micro(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUC over all (example, label) cells pooled.  Labels are not kept apart in the counts."""
    cells = score_cells(evaluated, by).withColumn("label_idx", F.lit(0))
    pooled = auc_per_label(score_counts(cells, by), by).where(F.col("label_idx") == POOLED)
    return pooled.select(*by, F.col("auc").alias("sk_auc_micro"))


def both_aucs(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and micro from one sorted pass."""
    return _areas(auc_per_label(score_counts(score_cells(evaluated, by), by), by), by)
