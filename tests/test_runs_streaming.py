"""Run logs, manifests, retention, slices; streams against the batch operators."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from polybag.catalog import tables as t
from polybag.operators import metrics, runs, scoring
from polybag.plans import evaluate
from polybag.sources import runs as files
from polybag.sources.batches import read_batches
from polybag.streaming import evaluation as live

LOG = """2021-01-15 00:11:06,861 - INFO: the 1 epoch's resnet result:  training loss 5.881546497344971,training per step cost 0.23 s, total_cost 763.72 s
2021-01-15 00:24:20,573 - INFO: the 2 epoch's resnet result:  training loss -4.4250054359436035,training per step cost 0.24 s, total_cost 793.71 s
2020-12-18 23:19:33,929 - INFO: the 1 epoch's resnet result:  training loss 0.2797913578611862,training per step cost 0.14 s, total_cost 1245.61 s
2020-12-18 23:25:39,857 - INFO: the 1 epoch's Eval result: f1_macro 0.29109520657475296, f1_micro 0.5977175463623395, auc 0.9131143166119532,eval cost 365.93 s
something else
2020-12-18 23:48:54,067 - INFO: the 2 epoch's Eval result: f1_macro 0.4803126504695009, f1_micro 0.6413352272727273, auc 0.9364969330561459,eval cost 268.62 s
"""


def test_parse_run_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(LOG)
    rows = files.read_run_log(spark, str(path)).orderBy("ts", "kind").collect()
    assert len(rows) == 5
    assert [r.loss for r in rows if r.kind == "train"] == [
        0.2797913578611862, 5.881546497344971, -4.4250054359436035]
    last = [r for r in rows if r.kind == "eval"][-1]
    assert (last.epoch, last.f1_macro, last.f1_micro, last.auc, last.cost_seconds) == (
        2, 0.4803126504695009, 0.6413352272727273, 0.9364969330561459, 268.62)
    assert rows[0].ts == datetime.datetime(2020, 12, 18, 23, 19, 33, 929000)


def test_log_lines_round_trip(spark):
    rows = spark.createDataFrame(
        [(datetime.datetime(2021, 1, 2, 3, 4, 5, 678000), 3, -1.5, 0.25, 12.0)],
        "ts timestamp, epoch bigint, loss double, step_seconds double, total_seconds double")
    parsed = runs.parse_run_log(runs.format_log_lines(rows)).first()
    assert (parsed.epoch, parsed.loss, parsed.step_seconds, parsed.cost_seconds) == (3, -1.5, 0.25, 12.0)


def test_epoch_loss(spark, tmp_path):
    start = datetime.datetime(2021, 1, 1)
    rows = [("r", start + datetime.timedelta(seconds=s), s + 1, float(s)) for s in range(10)]
    log = spark.createDataFrame(rows, "run_id string, ts timestamp, step bigint, loss double")
    found = {r.epoch: r for r in runs.epoch_loss(log, 5).collect()}
    assert found[1].loss == 2.0 and found[2].loss == 7.0 and found[1].steps == 5
    assert found[1].step_seconds == pytest.approx(0.8) and found[1].total_seconds == pytest.approx(4.0)
    assert runs.evaluated_epochs(log.withColumn("epoch", runs.epoch_of("step", 5)), 2).count() == 5
    table = str(tmp_path / "runs")
    # A job that runs again adds nothing; another batch and another writer do.
    added = [files.append_run_log(log, table, w, b) for w, b in (("a", 1), ("a", 1), ("a", 2), ("b/c", 1))]
    assert added == [True, False, True, True]
    found = read_batches(spark, table, log.schema)
    assert found.groupBy("writer", "batch").count().count() == 3 and found.count() == 30


def test_keep_latest(spark):
    saved = spark.createDataFrame([("a", e) for e in range(1, 8)] + [("b", 3)], "run_id string, epoch int")
    latest = runs.keep_latest(saved)
    assert sorted(tuple(r) for r in latest.collect()) == [("a", 6), ("a", 7), ("b", 3)]
    # Each map task keeps two rows per run before the shuffle.
    assert "WindowGroupLimit" in latest._jdf.queryExecution().toString()


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, {"lr": "0.1", "net": "r18"}, {"lr": "0.2", "out": "x"})],
        "run_id int, config map<string,string>, args map<string,string>")
    assert runs.run_manifest(rows).first().manifest == {"net": "r18", "lr": "0.2", "out": "x"}
    frame = files.manifest_frame(spark, {"lr": 0.1, "epochs": 40}, {"lr": 0.2, "mode": "gpu"})
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    files.write_manifest(frame, paths)
    for path in paths:
        text = spark.read.text(path).first().value
        assert json.loads(text) == {"lr": 0.2, "epochs": 40, "mode": "gpu"}


def test_positive_slices(spark):
    rows = spark.createDataFrame(
        [(0, [1, 1], [.9, .2]), (1, [1, 0], [.1, .3]), (2, [0, 0], [.4, .3])],
        "example_id bigint, gt array<int>, scores array<double>")
    found = {(r.label_idx, r.other_idx): r for r in runs.positive_slices(
        scoring.with_predictions(rows), 2).collect()}
    assert found[(0, 0)].n_examples == 2 and found[(1, 1)].n_examples == 1
    assert found[(0, 1)].n_gt == 1 and found[(0, 1)].n_pred == 1
    assert found[(0, 0)].mean_score == pytest.approx(0.5)


def _batch_events(spark, sf_dir):
    stream = t.stream_events(spark, sf_dir)
    assert stream.isStreaming
    types = ["click", "error", "purchase", "signup", "view"]
    from polybag.functions import hash_uniform

    events = t.table(spark, sf_dir, "events")
    own = F.array(*[(F.col("event_type") == c).cast("int") for c in types])
    scores = F.array(*[
        F.lit(0.3) * (F.col("event_type") == c).cast("int")
        + F.lit(0.7) * hash_uniform("stream", F.col("event_id"), c) for c in types])
    return scoring.with_predictions(events.select("event_id", own.alias("gt"), scores.alias("scores")))


def test_final_stream_state_equals_batch(spark, sf_dir):
    batch = _batch_events(spark, sf_dir)
    state = live.final_state(spark, live.confusion_state(t.stream_events(spark, sf_dir)))
    assert sorted(state.collect()) == sorted(metrics.confusion_counts(batch).collect())
    live_report, report = (
        {(r.metric, r.label_idx): r.value for r in rows.collect()} for rows in (
            live.final_state(spark, live.score_state(t.stream_events(spark, sf_dir)),
                             live.metrics_of_state),
            evaluate.full_report(batch)))
    assert set(live_report) == set(report)
    for name, value in live_report.items():
        assert value == pytest.approx(report[name], abs=1e-12), name


def test_stream_keeps_close_scores_apart(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, [1], [0.50003]), (1, [0], [0.50001])], "example_id bigint, gt array<int>, scores array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scoring.with_predictions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))

    def area(**rounding):
        state = live.final_state(spark, live.score_state(stream, **rounding), live.metrics_of_state)
        return {r.metric: r.value for r in state.collect()}["sk_auc_macro"]

    assert area() == 1.0 and area(decimals=4) == 0.5


def test_stream_continues_over_several_batches(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "example_id bigint, gt array<int>, scores array<double>"
    seen = []

    def sink(batch, _):
        seen.append({r.label_idx: (r.tp, r.fp, r.tn, r.fn) for r in batch.collect()})

    for part in range(2):
        rows = [(part * 10 + i, [i % 2, 1], [0.1 * i, 0.6]) for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = scoring.with_predictions(spark.readStream.schema(schema).parquet(source))
        live.start(live.confusion_state(stream), sink, mark).awaitTermination()
    assert seen[-1][1] == (8, 0, 0, 0)
    assert sum(seen[-1][0]) == 8 and sum(seen[0][0]) == 4
    assert out
