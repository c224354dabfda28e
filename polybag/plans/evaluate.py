"""Evaluation of scored bags: pool, threshold, compare, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.operators import auc, metrics, scoring
from polybag.operators.bags import label_bags
from polybag.operators.skew import BROADCAST_ROWS, Heavy


def evaluated_bags(instance_scores: DataFrame, annotations: DataFrame, n_classes: int,
                   decimals: int | None = None, heavy: Heavy | None = None) -> DataFrame:
    """(bag_id, sid, gt, scores, pred): mean score per bag next to its entity's annotation.

    ``instance_scores`` has bag_id, sid and scores; ``annotations`` has sid and gt.  The entity
    rides along as a grouping column, so annotations join the pooled rows once.
    """
    pooled = scoring.bag_scores(instance_scores, n_classes, ("bag_id", "sid"), decimals=decimals)
    return scoring.with_predictions(label_bags(pooled, annotations, heavy=heavy))


def instance_scores(members: DataFrame, scored: DataFrame, chosen: DataFrame,
                    limit: int = BROADCAST_ROWS) -> DataFrame:
    """(bag_id, sid, path, scores): the scores of bags' members, their arrays shuffled once.

    ``scored`` has (sid, path, scores) of any entities, ``chosen`` the sids of the members.  Both
    join keys deal the rows, so an entity of very many images is spread.  A short list of
    entities, which is counted, is broadcast to drop other entities' arrays before the shuffle; a
    longer one is not worth a shuffle of its own, as the join drops them anyhow.
    """
    sids = chosen.select("sid").distinct()
    wanted = scored.select("sid", "path", "scores")
    if sids.count() <= limit:
        wanted = wanted.join(F.broadcast(sids), "sid", "left_semi")
    return members.select("bag_id", "sid", "path").join(wanted, ["sid", "path"])


def full_report(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All report metrics, overall and per label: (by, metric, label_idx, value).

    Two passes over the evaluated rows: one aggregate for everything countable, one sort for
    the two AUC values.  Hand in a saved table, as pooling would otherwise run twice.
    """
    overall, labels = metrics.all_metrics(evaluated, by)
    return metrics.report_rows(overall, labels, auc.both_aucs(evaluated, by), by)


def brief_report(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The thirteen overall metrics that need no scores."""
    overall, _ = metrics.all_metrics(evaluated, by)
    return metrics.melt(overall, metrics.BRIEF_METRICS, by)


def headline(evaluated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(f1_macro, f1_micro, auc) as an evaluation returns them, one row per ``by``.

    One shuffle of the cells; F1 and AUC are both derived from its counts.
    """
    outcomes = auc.outcome_counts(evaluated, by)
    # A constant key lines up the two one-row results when there is no other.
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    names = list(by) or ["_all"]
    f1 = metrics.f1_zero_division(auc.confusion_of(outcomes, by), by).select(
        *keys, F.col("sk_f1_macro").alias("f1_macro"), F.col("sk_f1_micro").alias("f1_micro"))
    area = auc.areas_of(outcomes, by).select(*keys, F.col("sk_auc_macro").alias("auc"))
    return f1.join(area, names).drop("_all")
