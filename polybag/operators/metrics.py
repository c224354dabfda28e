"""Multi-label metrics.

Input is the evaluated table: one row per example with arrays ``gt``, ``scores`` and ``pred``
of equal length.  Every function takes ``by``, extra key columns such as ``epoch``; with none,
the result is one set of metrics.

Two families of F1 are kept apart on purpose: the smoothed one (``eps_ratio``: an empty label
scores 1) and the zero-division one (an empty label scores 0).  ``label_f1_macro`` is the F1 of
the macro precision and recall; ``label_f1_average`` the mean of the per-label F1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.functions import eps_ratio, f1_score

By = Sequence[str]

# Report order (fixed values).
BRIEF_METRICS = [
    "example_subset_accuracy", "example_accuracy", "example_precision", "example_recall",
    "example_f1", "label_accuracy_macro", "label_precision_macro", "label_recall_macro",
    "label_f1_macro", "label_accuracy_micro", "label_precision_micro", "label_recall_micro",
    "label_f1_micro",
]
REPORT_METRICS = BRIEF_METRICS + [
    "sk_auc_macro", "sk_auc_micro", "sk_f1_macro", "sk_f1_micro", "lab_sensitivity",
    "lab_specificity", "label_f1_average",
]
# The short score file: its line names and the metric behind each.
SCORE_METRICS = {
    "auc": "sk_auc_macro", "f1_macro": "sk_f1_macro", "f1_micro": "sk_f1_micro",
    "sensitivity": "lab_sensitivity", "specificity": "lab_specificity",
}
LABEL_METRICS = ["label_accuracy", "lab_precision", "lab_recall", "lab_f1"]


def _overlap(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, v: s + v)


def _count(a: str) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, v: s + v)


def _example_terms(evaluated: DataFrame, by: By, keep: Sequence[str] = ()) -> DataFrame:
    """Per-example contributions, computed in the row: no shuffle by example."""
    sums = evaluated.select(
        *by, "gt", "pred", *keep,
        _overlap("gt", "pred").alias("_both"),
        _count("gt").alias("_gt"),
        _count("pred").alias("_pred"),
    )
    either = F.col("_gt") + F.col("_pred") - F.col("_both")
    return sums.select(
        *by, "gt", "pred", *keep,
        (F.col("gt") == F.col("pred")).cast("double").alias("_exact"),
        eps_ratio("_both", either).alias("_acc"),
        eps_ratio("_both", "_pred").alias("_prec"),
        eps_ratio("_both", "_gt").alias("_rec"),
    )


def example_metrics(evaluated: DataFrame, by: By = ()) -> DataFrame:
    """Subset accuracy, accuracy, precision, recall, and the F1 of the last two means."""
    means = _example_terms(evaluated, by).groupBy(*by).agg(
        F.avg("_exact").alias("example_subset_accuracy"),
        F.avg("_acc").alias("example_accuracy"),
        F.avg("_prec").alias("example_precision"),
        F.avg("_rec").alias("example_recall"),
    )
    return means.withColumn("example_f1", f1_score("example_precision", "example_recall"))


def _outcomes() -> list[Column]:
    g, p = F.col("_c.gt"), F.col("_c.pred")
    return [
        F.sum(g * p).alias("tp"),
        F.sum((1 - g) * p).alias("fp"),
        F.sum((1 - g) * (1 - p)).alias("tn"),
        F.sum(g * (1 - p)).alias("fn"),
    ]


def confusion_counts(evaluated: DataFrame, by: By = ()) -> DataFrame:
    """tp, fp, tn, fn per label: one aggregate, combined before the shuffle."""
    cells = evaluated.select(
        *by, F.posexplode(F.arrays_zip("gt", "pred")).alias("label_idx", "_c"))
    return cells.groupBy(*by, "label_idx").agg(*_outcomes())


def _per_label(counts: DataFrame) -> DataFrame:
    precision, recall = eps_ratio("tp", F.col("tp") + F.col("fp")), eps_ratio(
        "tp", F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return (
        counts.withColumn("label_accuracy", eps_ratio(F.col("tp") + F.col("tn"), total))
        .withColumn("lab_precision", precision)
        .withColumn("lab_recall", recall)
        .withColumn("lab_f1", f1_score("lab_precision", "lab_recall"))
    )


def per_label_metrics(counts: DataFrame, by: By = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of each label, from confusion counts."""
    return _per_label(counts).select(*by, "label_idx", *LABEL_METRICS)


def _macro_columns() -> list[Column]:
    return [
        F.avg("label_accuracy").alias("label_accuracy_macro"),
        F.avg("lab_precision").alias("label_precision_macro"),
        F.avg("lab_recall").alias("label_recall_macro"),
        F.avg("lab_f1").alias("label_f1_average"),
    ]


def label_macro_metrics(counts: DataFrame, by: By = ()) -> DataFrame:
    """Means over labels; both macro F1 values."""
    return (
        _per_label(counts).groupBy(*by).agg(*_macro_columns())
        .withColumn("label_f1_macro", f1_score("label_precision_macro", "label_recall_macro"))
    )


def _pooled_columns() -> list[Column]:
    return [F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "tn", "fn")]


def _micro(pooled: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(f"_{c}") for c in ("tp", "fp", "tn", "fn"))
    return (
        pooled.withColumn("label_accuracy_micro", eps_ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("label_precision_micro", eps_ratio(tp, tp + fp))
        .withColumn("label_recall_micro", eps_ratio(tp, tp + fn))
        .withColumn("label_f1_micro", f1_score("label_precision_micro", "label_recall_micro"))
        .withColumn("lab_sensitivity", F.col("label_recall_micro"))
        .withColumn("lab_specificity", eps_ratio(tn, tn + fp))
    )


def label_micro_metrics(counts: DataFrame, by: By = ()) -> DataFrame:
    """Metrics of the pooled counts; sensitivity is the pooled recall."""
    pooled = counts.groupBy(*by).agg(*_pooled_columns())
    return _micro(pooled).drop("_tp", "_fp", "_tn", "_fn")


def _zero_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def f1_zero_division(counts: DataFrame, by: By = ()) -> DataFrame:
    """F1 macro and micro without smoothing; undefined counts as 0."""
    per_label = _zero_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.groupBy(*by).agg(
        F.avg(per_label).alias("sk_f1_macro"),
        _zero_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("sk_f1_micro"),
    )


# Sums over the examples, as carried next to the counts of a label.
EXAMPLE_TERMS = ("_exact", "_acc", "_prec", "_rec", "_examples")


def outcome_cells(evaluated: DataFrame, by: By = (), keep: Sequence[str] = ()) -> DataFrame:
    """(by, label_idx, _c, example terms) rows; ``_c`` has gt, pred and the arrays of ``keep``.

    The terms of an example ride on its first cell, so they can be summed along with the counts.
    """
    cells = _example_terms(evaluated, by, keep).withColumn("_examples", F.lit(1)).select(
        *by, *EXAMPLE_TERMS,
        F.posexplode(F.arrays_zip("gt", "pred", *keep)).alias("label_idx", "_c"))
    return cells.select(*by, "label_idx", "_c", *[
        F.when(F.col("label_idx") == 0, F.col(t)).otherwise(0).alias(t) for t in EXAMPLE_TERMS])


def term_sums() -> list[Column]:
    return [F.sum(t).alias(t) for t in EXAMPLE_TERMS]


def all_metrics(evaluated: DataFrame, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """All but the AUC from one pass: (overall metrics, per-label metrics)."""
    return metrics_of_counts(outcome_cells(evaluated, by).groupBy(*by, "label_idx").agg(
        *_outcomes(), *term_sums()), by)


def metrics_of_counts(counts: DataFrame, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """(overall, per label) from confusion counts and example terms per label."""
    labels = _per_label(counts)
    examples = F.sum("_examples")
    names = ["example_subset_accuracy", "example_accuracy", "example_precision",
             "example_recall"]
    zero_division = _zero_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    overall = labels.groupBy(*by).agg(
        *[(F.sum(t) / examples).alias(n) for t, n in zip(EXAMPLE_TERMS, names)],
        *_macro_columns(),
        *_pooled_columns(),
        F.avg(zero_division).alias("sk_f1_macro"),
        _zero_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("sk_f1_micro"),
    )
    overall = (
        _micro(overall)
        .withColumn("example_f1", f1_score("example_precision", "example_recall"))
        .withColumn("label_f1_macro", f1_score("label_precision_macro", "label_recall_macro"))
        .drop("_tp", "_fp", "_tn", "_fn")
    )
    return overall, labels.select(*by, "label_idx", *LABEL_METRICS)


def report_rows(overall: DataFrame, labels: DataFrame, areas: DataFrame, by: By = ()) -> DataFrame:
    """The whole report as (by, metric, label_idx, value) rows."""
    countable = [m for m in REPORT_METRICS if not m.startswith("sk_auc")]
    return (
        melt(overall, countable, by)
        .unionByName(melt(areas, ["sk_auc_macro", "sk_auc_micro"], by))
        .unionByName(melt_labels(labels, by))
    )


def melt(overall: DataFrame, names: Sequence[str], by: By = ()) -> DataFrame:
    """One-row metrics to (metric, label_idx NULL, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in names])
    return overall.select(*by, F.explode(pairs).alias("_m")).select(
        *by, "_m.metric", F.lit(None).cast("int").alias("label_idx"), "_m.value")


def melt_labels(labels: DataFrame, by: By = ()) -> DataFrame:
    """Per-label metrics to (metric, label_idx, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in LABEL_METRICS])
    return labels.select(*by, "label_idx", F.explode(pairs).alias("_m")).select(
        *by, "_m.metric", "label_idx", "_m.value")


def subset_metrics(overall: DataFrame) -> DataFrame:
    """The five-line score file: each name next to its metric."""
    return melt(overall.select(*[F.col(m).alias(n) for n, m in SCORE_METRICS.items()]),
                list(SCORE_METRICS))
