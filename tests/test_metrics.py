"""Metrics: hand-worked goldens, brute force, and Spark ML as a cross-check."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MultilabelClassificationEvaluator
from pyspark.sql import functions as F

from polybag.operators import auc, metrics, scoring
from polybag.plans import evaluate
from polybag.sources import runs as files

GT = [[1, 0, 0, 0], [0, 1, 1, 0], [1, 1, 0, 0], [0, 0, 1, 0]]
SCORES = [[.9, .2, .1, .05], [.3, .6, .4, .05], [.7, .45, .2, .05], [.1, .3, .2, .05]]
PRED = [[1, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0]]
SCHEMA = "example_id bigint, gt array<int>, scores array<double>"


@pytest.fixture(scope="module")
def golden(spark):
    rows = spark.createDataFrame(list(zip(range(4), GT, SCORES)), SCHEMA)
    return scoring.with_predictions(rows)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    n, k = 400, 5
    gt = (rng.random((n, k)) < 0.3).astype(int)
    scores = np.round(np.clip(0.3 * gt + 0.6 * rng.random((n, k)), 0, 1), 2)
    return gt, scores


@pytest.fixture(scope="module")
def evaluated(spark, sample):
    gt, scores = sample
    rows = [(i, g.tolist(), s.tolist()) for i, (g, s) in enumerate(zip(gt, scores))]
    return scoring.with_predictions(spark.createDataFrame(rows, SCHEMA).repartition(6))


def test_threshold_gives_every_example_a_label(golden):
    assert [r.pred for r in golden.orderBy("example_id").collect()] == PRED


def test_ties_at_the_largest_score_all_fire(spark):
    row = spark.createDataFrame([(0, [0, 0, 0], [.2, .2, .1])], SCHEMA)
    assert scoring.with_predictions(row).first().pred == [1, 1, 0]


EXPECTED = {
    "example_subset_accuracy": 0.25, "example_accuracy": 0.5, "example_precision": 0.75,
    "example_recall": 0.5, "example_f1": 0.6, "label_accuracy_macro": 0.75,
    "label_precision_macro": 0.875, "label_recall_macro": 0.625, "label_f1_macro": 0.729167,
    "label_f1_average": 0.625, "label_accuracy_micro": 0.75, "label_precision_micro": 0.75,
    "label_recall_micro": 0.5, "lab_sensitivity": 0.5, "label_f1_micro": 0.6,
    "lab_specificity": 0.9, "sk_f1_macro": 0.375, "sk_f1_micro": 0.6, "sk_auc_macro": -1.0,
    "sk_auc_micro": 0.95,
}


def test_report_golden(golden):
    report = evaluate.full_report(golden)
    overall = {r.metric: r.value for r in report.where("label_idx IS NULL").collect()}
    assert set(overall) == set(metrics.REPORT_METRICS)
    for name, value in EXPECTED.items():
        assert overall[name] == pytest.approx(value, abs=1e-6), name
    assert report.where("label_idx IS NOT NULL").count() == 16


def test_separate_operators_agree_with_the_report(golden):
    counts = metrics.confusion_counts(golden)
    assert [tuple(r)[1:] for r in counts.orderBy("label_idx").collect()] == [
        (2, 0, 2, 0), (1, 1, 1, 1), (0, 0, 2, 2), (0, 0, 4, 0)]
    found = {}
    for frame in (metrics.example_metrics(golden), metrics.label_macro_metrics(counts),
                  metrics.label_micro_metrics(counts), metrics.f1_zero_division(counts)):
        found.update(frame.first().asDict())
    for name, value in found.items():
        assert value == pytest.approx(EXPECTED[name], abs=1e-6), name


def test_empty_label_scores_one_with_smoothing(golden):
    row = metrics.per_label_metrics(metrics.confusion_counts(golden)).where("label_idx = 3").first()
    assert row.lab_precision == row.lab_recall == pytest.approx(1.0)


def test_auc_golden(golden):
    per_label = auc.auc_per_label(auc.score_counts(auc.score_cells(golden)))
    values = {r.label_idx: r.auc for r in per_label.collect()}
    assert values[0] == values[1] == 1.0 and values[2] == 0.875 and values[3] is None
    assert auc.auc_macro(per_label).first()[0] == -1.0
    assert values[auc.POOLED] == pytest.approx(0.95)
    assert auc.auc_macro(per_label.where("label_idx < 3")).first()[0] == pytest.approx(0.958333, abs=1e-6)


def _brute(gt, score):
    pos, neg = score[gt == 1], score[gt == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_equals_brute_force_with_ties(evaluated, sample):
    gt, scores = sample
    row = auc.both_aucs(evaluated).first()
    per_label = [_brute(gt[:, k], scores[:, k]) for k in range(gt.shape[1])]
    assert row.sk_auc_macro == pytest.approx(np.mean(per_label), abs=1e-12)
    assert row.sk_auc_micro == pytest.approx(_brute(gt.ravel(), scores.ravel()), abs=1e-12)
    assert auc.auc_micro(evaluated).first()[0] == pytest.approx(row.sk_auc_micro, abs=1e-12)


def test_auc_does_not_change_under_monotone_maps(evaluated):
    mapped = evaluated.withColumn("scores", F.transform("scores", lambda s: s * s * s + 1))
    before, after = auc.both_aucs(evaluated).first(), auc.both_aucs(mapped).first()
    assert tuple(before) == pytest.approx(tuple(after), abs=1e-12)


def test_auc_with_all_scores_in_a_sliver(spark):
    rng = np.random.default_rng(2)
    gt, score = (rng.random(3000) < 0.4).astype(int), 0.5 + rng.random(3000) * 1e-9
    rows = spark.createDataFrame(
        [(int(g), float(s)) for g, s in zip(gt, score)], "gt int, score double").repartition(8)
    counts = auc.score_counts(rows.withColumn("label_idx", F.lit(0)))
    found = auc.auc_per_label(counts).collect()
    assert len(found) == 2
    assert all(r.auc == pytest.approx(_brute(gt, score), abs=1e-12) for r in found)


def test_ties_across_arrow_batches_count_once():
    counts = pd.DataFrame({"label_idx": [0, 1, 2, 0, 1], "score": [.5, .5, .5, .7, .7],
                           "pos": [1, 2, 0, 3, 1], "neg": [4, 1, 1, 0, 2]})
    whole = auc._piece_sums([])([counts])
    parts = auc._piece_sums([])([counts[:1], counts[1:2], counts[2:4], counts[4:]])
    assert pd.concat(whole).sort_values("label_idx").values.tolist() == pd.concat(
        parts).sort_values("label_idx").values.tolist()


def test_spark_ml_agrees_where_the_rules_coincide(spark, evaluated, sample):
    cells = auc.score_cells(evaluated).select(
        F.col("gt").cast("double").alias("label"), F.col("score").alias("rawPrediction"))
    ml = BinaryClassificationEvaluator(numBins=0).evaluate(cells)
    assert auc.auc_micro(evaluated).first()[0] == pytest.approx(ml, abs=1e-9)

    def positives(c):
        return F.filter(F.transform(c, lambda v, i: F.when(v == 1, i.cast("double"))),
                        lambda v: v.isNotNull())
    sets = evaluated.select(positives("gt").alias("label"), positives("pred").alias("prediction"))
    micro = MultilabelClassificationEvaluator(metricName="microF1Measure").evaluate(sets)
    ours = metrics.f1_zero_division(metrics.confusion_counts(evaluated)).first()
    assert ours.sk_f1_micro == pytest.approx(micro, abs=1e-9)


def test_the_two_f1_families_differ_only_by_smoothing(evaluated):
    counts = metrics.confusion_counts(evaluated)
    smooth = metrics.label_macro_metrics(counts).first().label_f1_average
    assert smooth == pytest.approx(metrics.f1_zero_division(counts).first().sk_f1_macro, abs=1e-6)


def test_micro_counts_cover_every_cell(evaluated, sample):
    totals = metrics.confusion_counts(evaluated).agg(F.sum(F.expr("tp + fp + tn + fn"))).first()[0]
    assert totals == sample[0].size


def test_metrics_by_a_key_equal_metrics_of_each_part(evaluated):
    keyed = evaluated.withColumn("epoch", F.col("example_id") % 2)
    rows = {r.epoch: r for r in evaluate.headline(keyed, ["epoch"]).collect()}
    for epoch in (0, 1):
        alone = evaluate.headline(keyed.where(F.col("epoch") == epoch).drop("epoch")).first()
        assert (rows[epoch].f1_macro, rows[epoch].f1_micro, rows[epoch].auc) == pytest.approx(
            tuple(alone), abs=1e-12)
    report = evaluate.full_report(keyed, ["epoch"])
    assert report.count() == 2 * (len(metrics.REPORT_METRICS) + 4 * 5)


def test_pooling_and_alignment(spark):
    instances = spark.createDataFrame(
        [("b1", [.2, .4]), ("b1", [.4, .8]), ("b2", [1., 0.])], "bag_id string, scores array<double>")
    pooled = {r.bag_id: (r.scores, r.nslice) for r in scoring.bag_scores(instances, 2).collect()}
    assert pooled["b1"][0] == pytest.approx([.3, .6]) and pooled["b1"][1] == 2
    a = spark.createDataFrame([("b1",), ("b3",)], "bag_id string")
    assert {r.bag_id: r.sides for r in scoring.unmatched(a, instances, "bag_id").collect()} == {
        "b3": 1, "b2": 2}


def test_user_scorer_sees_whole_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)],
                               "id bigint, embedding array<double>")
    out = scoring.apply_scorer(df, lambda m: m @ np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]]))
    assert all(r.scores == [r.id, 1.0, 2.0 * r.id + 1.0] for r in out.collect())


def test_console_report(spark, golden, capsys):
    report = evaluate.full_report(golden)
    files.print_report(report)
    shown = {line.split("|")[1].strip(): line.split("|")[2].strip()
             for line in capsys.readouterr().out.splitlines() if line.startswith("|")}
    shown.pop("metric")
    assert set(shown) == set(metrics.REPORT_METRICS) | {r.metric for r in report.collect() if r.label_idx is None}
    assert float(shown["example_subset_accuracy"]) == pytest.approx(0.25)


def test_report_files(spark, golden, tmp_path):
    report = evaluate.full_report(golden).persist()
    table = str(tmp_path / "table")
    for epoch in (1, 2, 2):
        files.append_report(report, table, "eval", epoch)
    assert spark.read.parquet(table).count() == 2 * report.count()
    files.overwrite_report(report, table)
    assert spark.read.parquet(table).count() == report.count()
    values = {(r.metric, r.label_idx): f"{r.value:.4f}" for r in report.collect()}
    padded = [f"{m + ':':<27}{values[m, None]}" for m in metrics.REPORT_METRICS[:-1]]
    lists = [("label_accuracy", "label_accuracy_macro: ", "label_accuracy: "),
             ("lab_precision", "label_precious_macro: ", "lab_precision:  "),
             ("lab_recall", "label_recall_macro: ", "lab_recall:     "),
             ("lab_f1", "label_f1_macro: ", "lab_f1:         ")]
    full = ["-" * 44, *padded, "", f"label_f1_average: {values['label_f1_average', None]}"]
    for name, title, word in lists:
        full += [title, *(f"(label:{i},{word}{values[name, i]})" for i in range(4))]

    def lines(layout):
        return [r.line for r in files.report_lines(report, layout).orderBy("line_no").collect()]

    assert lines("full") == full and full[1] == "example_subset_accuracy:   0.2500"
    assert lines("brief") == padded[:13]
    assert lines("score") == [f"{short}:{values[m, None]}" for short, m in (
        ("auc", "sk_auc_macro"), ("f1_macro", "sk_f1_macro"), ("f1_micro", "sk_f1_micro"),
        ("sensitivity", "lab_sensitivity"), ("specificity", "lab_specificity"))]
    text = str(tmp_path / "text")
    for epoch in (1, 2, 2):
        files.write_report_text(report, text, batch=epoch)
    written = [r.value for r in spark.read.text(text).collect()]
    assert written.count(files.RULE) == 2 and sorted(written) == sorted(full * 2)
    brief = {r.metric for r in evaluate.brief_report(golden).collect()}
    assert brief == set(metrics.BRIEF_METRICS)
    short = {r.metric: r.value for r in metrics.subset_metrics(
        report.groupBy().pivot("metric", metrics.REPORT_METRICS).agg(F.max(
            F.when(F.col("label_idx").isNull(), F.col("value"))))).collect()}
    assert short["auc"] == -1.0 and short["specificity"] == pytest.approx(0.9)
