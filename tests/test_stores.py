"""State of streams in files, closing epochs, progress, sinks that may run again, retention."""

import datetime
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from polybag.catalog import tables as t
from polybag.operators import auc, scoring
from polybag.plans import evaluate
from polybag.session import job_folder, saved, scratch_path
from polybag.sources import batches, folders, retention
from polybag.streaming import epochs, evaluation as live, progress
from polybag.streaming.store import CountStore, Run

EXAMPLES = "example_id bigint, gt array<int>, scores array<double>"


def examples(spark, n, seed=0, places=3):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(0, 1), rng.randint(0, 1)], [round(rng.random(), places) for _ in range(2)])
            for i in range(n)]
    return spark.createDataFrame(rows, EXAMPLES)


def values(report):
    return {(r.metric, r.label_idx): r.value for r in report.collect()}


def store_for(spark, path, fan=3):
    counts = auc.outcome_counts(scoring.with_predictions(examples(spark, 2)))
    return CountStore(str(path), counts.schema, ["label_idx", "score", "pred"], fan)


def test_store_over_many_batches(spark, tmp_path):
    """Rows written per batch follow the batch; the report is that of all rows at once."""
    store, rows, written, live_runs = store_for(spark, tmp_path / "s"), None, [], []
    for batch in range(20):
        part = scoring.with_predictions(examples(spark, 30, seed=batch))
        rows = part if rows is None else rows.unionByName(part)
        store.append(auc.outcome_counts(part), batch)
        fresh = store._read(spark, [Run(0, batch, batch)]) if folders.committed(
            spark, f"{store.path}/{Run(0, batch, batch).name}") else None
        written.append(fresh.count() if fresh else 0)
        live_runs.append(len(store.runs(spark)))
    assert max(written) <= 60 and max(live_runs) <= 2 * 3 + 1
    # Every batch is in exactly one live run.
    spans = [(r.first, r.last) for r in store.runs(spark)]
    assert spans[0][0] == 0 and spans[-1][1] == 19 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    got, want = values(live.metrics_of_state(store.total(spark))), values(evaluate.full_report(rows))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_store_survives_repeats_and_broken_writes(spark, tmp_path):
    store = store_for(spark, tmp_path / "s", fan=2)
    counts = [auc.outcome_counts(scoring.with_predictions(examples(spark, 10, seed=i))) for i in range(3)]
    total = sum(c.agg(F.sum("pos") + F.sum("neg")).first()[0] for c in counts)
    assert store.total(spark).count() == 0
    for i in (0, 0, 1, 1, 2, 2, 0):  # 0 and 1 are folded; 0 comes again after that
        store.append(counts[i], i)
    assert [(r.level, r.first, r.last) for r in store.runs(spark)] == [(1, 0, 1), (0, 2, 2)]
    # A run without its mark is not there.
    broken = f"{store.path}/{Run(5, 0, 9).name}"
    counts[0].write.parquet(broken)
    folders.remove(spark, f"{broken}/{folders.COMMITTED}")
    assert store.total(spark).agg(F.sum("pos") + F.sum("neg")).first()[0] == total
    with pytest.raises(ValueError):
        store_for(spark, tmp_path / "t", fan=1)


def stream_of(spark, path, schema, **options):
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(str(path))


def test_evaluator_resumes_and_reports_in_between(spark, tmp_path):
    schema, seen, rows = examples(spark, 1).schema, [], None
    for round_ in range(3):
        part = examples(spark, 25, seed=round_)
        rows = part if rows is None else rows.unionByName(part)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = scoring.with_predictions(stream_of(spark, tmp_path / "in", schema))
        evaluator = live.StreamEvaluator(stream, str(tmp_path / "out"), fan=2)
        evaluator.start(after=seen.append).awaitTermination()
        want = values(evaluate.full_report(scoring.with_predictions(rows)))
        assert values(evaluator.report()) == pytest.approx(want, abs=1e-12)
    assert seen == [0, 1, 2]


def test_a_batch_is_scored_by_many_tasks(spark, tmp_path):
    """A part stays one batch; its file, which one task reads, does not say how many score it."""
    rows = [(i if i % 7 else None, START, i, "view", 0.5, "{}") for i in range(400)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    seen = []

    def look(batch, _):
        seen.append((batch.count(), batch.rdd.getNumPartitions()))

    stream = t.event_batches(spark, str(tmp_path), 8)
    stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "mark")).trigger(
        availableNow=True).start().awaitTermination()
    assert sorted(n for n, _ in seen) == sorted([58] + [len([i for i in range(400) if i % 7 and i % 8 == k])
                                                        for k in range(8)])
    assert all(tasks >= 8 for _, tasks in seen)


def test_the_report_moves_the_rows_of_the_runs_once(spark, tmp_path):
    """Scores that come again in other runs and batches count as one, without sums of their own."""
    store, parts = store_for(spark, tmp_path / "s", fan=2), []
    for batch in range(3):
        parts.append(scoring.with_predictions(examples(spark, 40, seed=batch, places=1)))
        store.append(auc.outcome_counts(parts[-1]), batch)
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert store.rows(spark).count() > store.total(spark).count()
    want = values(evaluate.full_report(rows))
    assert values(live.metrics_of_state(store.rows(spark))) == pytest.approx(want, abs=1e-12)
    plan = auc.areas_of(store.rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(score" in plan and not re.search(r"hashpartitioning\(label_idx#\d+, score", plan)


def test_streams_without_anything(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    stream = scoring.with_predictions(stream_of(spark, tmp_path / "in", EXAMPLES))
    report = live.evaluated_stream(stream)
    assert report.where("metric LIKE 'sk_auc%' AND value > 0").count() == 0
    assert live.final_state(spark, live.confusion_state(stream)).count() == 0
    log = stream_of(spark, tmp_path / "in", LOG)
    assert epochs.epochs_so_far(log, 5).count() == 0
    assert progress.progress_rows(spark, str(tmp_path / "none")).count() == 0


LOG = "run_id string, ts timestamp, step bigint, loss double"
START = datetime.datetime(2021, 1, 1)


def log_rows(spark, rows):
    """(run, second, step, loss) as rows of a run log."""
    return spark.createDataFrame([(r, START + datetime.timedelta(seconds=s), n, x) for r, s, n, x in rows], LOG)


class Epochs:
    """A stream of run-log files, and what it has given out so far."""

    def __init__(self, spark, path, **choices):
        self.spark, self.path, self.choices, self.out = spark, str(path), choices, []

    def feed(self, rows):
        log_rows(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = stream_of(self.spark, f"{self.path}/in", LOG)
        before = len(self.out)

        def write(found, batch):
            self.out.extend((r.run_id, r.epoch, r.loss, r.steps) for r in found.collect())

        epochs.start_epochs(epochs.closed_epochs(stream, 3, **self.choices), write,
                            f"{self.path}/mark").awaitTermination()
        return sorted(self.out[before:], key=repr)

    def open(self):
        return sorted(((r.run_id, r.epoch, r.loss, r.steps) for r in epochs.open_epochs(
            self.spark, f"{self.path}/mark").collect()), key=repr)


def test_an_epoch_is_given_out_once_when_it_is_full(spark, tmp_path):
    log = Epochs(spark, tmp_path, delay="1 hour", patience_ms=3_600_000)
    assert log.feed([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), (None, 3, 1, 8.0)]) == []
    assert log.open() == [("a", 1, 1.5, 2), (None, 1, 8.0, 1)]
    # The third step closes the epoch; the next one has begun.
    assert log.feed([("a", 4, 3, 6.0), ("a", 5, 4, None)]) == [("a", 1, 3.0, 3)]
    assert log.open() == [("a", 2, None, 1), (None, 1, 8.0, 1)]
    # A late step of a closed epoch neither changes nor repeats it.
    assert log.feed([("a", 6, 2, 100.0)]) == []
    assert log.open() == [("a", 2, None, 1), (None, 1, 8.0, 1)]


def test_an_epoch_closes_by_time_and_leaves_the_state(spark, tmp_path):
    log = Epochs(spark, tmp_path, complete=False, patience_ms=10_000, forget_ms=20_000)
    assert log.feed([("a", 0, 1, 1.0), ("a", 1, 2, 3.0), ("b", 95, 1, 5.0)]) == [("a", 1, 2.0, 2)]
    assert log.open() == [("b", 1, 5.0, 1)]
    assert log.feed([("a", 96, 3, 9.0)]) == []  # its mark has been forgotten: a new part of that epoch
    assert log.feed([("c", 300, 1, 0.0)]) == [("a", 1, 9.0, 1), ("b", 1, 5.0, 1)]
    # Their marks are overdue and go with the next batch.
    assert log.feed([("c", 301, 2, 0.0)]) == []
    states = spark.read.format("statestore").option("stateVarName", "epoch").load(f"{tmp_path}/mark")
    assert [r.key.run_id for r in states.collect()] == ["c"]


def test_epochs_of_the_test_events(spark, sf_dir):
    want = t.step_log(t.table(spark, sf_dir, "events")).groupBy(
        "run_id", F.expr(f"(step - 1) div {t.STEPS_PER_EPOCH} + 1").alias("epoch")).agg(
        F.avg("loss").alias("loss"), F.count("*").alias("steps"))
    stream = t.step_log(spark.readStream.schema(t.table(spark, sf_dir, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(sf_dir))
    found = epochs.epochs_so_far(stream, t.STEPS_PER_EPOCH)
    assert found.where("closed").count() > 0

    def plain(rows):
        return sorted((r.run_id, r.epoch, r.steps, round(r.loss, 9)) for r in rows.collect())
    assert plain(found) == plain(want)


def test_progress_log(spark, tmp_path):
    examples(spark, 40).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = scoring.with_predictions(stream_of(spark, tmp_path / "in", EXAMPLES, maxFilesPerTrigger=1))
    evaluator = live.StreamEvaluator(stream, str(tmp_path / "out"))
    with progress.ProgressLog(spark, str(tmp_path / "log")) as log:
        query = evaluator.start()
        log.wait(query)
    rows = progress.progress_rows(spark, str(tmp_path / "log")).where("input_rows > 0").collect()
    assert sorted(r.batch for r in rows) == [0, 1, 2, 3] and sum(r.input_rows for r in rows) == 40
    assert {r.query_id for r in rows} == {str(query.id)} and all(r.duration_ms >= 0 and r.ts for r in rows)
    # The same event once more is the same row.
    path = next((tmp_path / "log").rglob("batch=*1.json"))
    folders.write_text(spark, str(path), path.read_text())
    assert json.loads(path.read_text())["batch"] == 1
    assert progress.progress_rows(spark, str(tmp_path / "log")).where("input_rows > 0").count() == 4


def test_a_batch_without_its_mark_is_written_again(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "x")], "id int, name string"), str(tmp_path / "t")
    assert batches.read_batches(spark, path, rows.schema).columns == ["id", "name", "writer", "batch"]
    batches.append_batch(rows, path, "w", 7)
    [folder] = batches.committed_batches(spark, path)
    folders.remove(spark, f"{folder}/{folders.COMMITTED}")
    assert batches.read_batches(spark, path, "id int, name string").count() == 0
    assert batches.append_batch(rows, path, "w", 7)
    assert batches.append_batch(rows.limit(0), path, "w", 8) and not batches.append_batch(rows, path, "w", 8)
    assert [tuple(r) for r in batches.read_batches(spark, path, rows.schema).collect()] == [(1, "x", "w", 7)]
    batches.drop_batches(spark, path, "w")
    assert batches.append_batch(rows, path, "w", 7)
    with pytest.raises(ValueError):
        batches.append_batch(rows.withColumn("batch", F.lit(1)), path, "w", 9)


def test_expire_outputs(spark, tmp_path):
    def names():
        return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("run=*/*") if p.is_dir())

    for run, numbers in {"a": [1, 2, 10, 9], "b": [3], "c": []}.items():
        os.makedirs(tmp_path / f"run={run}", exist_ok=True)
        for n in numbers:
            spark.range(2).write.parquet(str(tmp_path / f"run={run}" / f"epoch={n}"))
    os.makedirs(tmp_path / "run=a" / "_temporary")
    retention.hold(spark, str(tmp_path / "run=a" / "epoch=1"))
    gone = retention.expire_outputs(spark, str(tmp_path), keep=2)
    assert [os.path.basename(p) for p in gone] == ["epoch=2"]
    assert names() == ["run=a/_temporary", "run=a/epoch=1", "run=a/epoch=10", "run=a/epoch=9", "run=b/epoch=3"]
    # The lease has run out: the old output goes now.
    later = datetime.datetime.now().timestamp() + 2 * retention.HOUR
    assert len(retention.expire_outputs(spark, str(tmp_path), keep=2, now=later)) == 1
    with retention.held(spark, str(tmp_path / "run=a" / "epoch=9")):
        assert retention.expire_outputs(spark, str(tmp_path), keep=1) == []
    assert len(retention.expire_outputs(spark, str(tmp_path), keep=1)) == 1
    assert names() == ["run=a/_temporary", "run=a/epoch=10", "run=b/epoch=3"]
    assert retention.expire_outputs(spark, str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        retention.expire_outputs(spark, str(tmp_path), keep=-1)


@pytest.mark.parametrize("local", [True, False])
def test_many_outputs_expire_in_few_calls(spark, tmp_path, monkeypatch, local):
    """Listing, leases and removal do not ask the file system anew for each output."""
    root, asked, place = tmp_path / "out{a}[1]", [], folders._place
    for run in ("run=x{1}", "run=b*c"):
        for n in range(60):
            os.makedirs(root / run / f"epoch={n}")
            (root / run / f"epoch={n}" / ".part.crc").touch()
    (root / "run=b*c" / "epoch=99").touch()  # not an output
    (root / "run=b*c" / ".epoch=98.crc").touch()
    for held in ("run=x{1}/epoch=5", "run=b*c/epoch=59"):
        retention.hold(spark, str(root / held))
    monkeypatch.setattr(folders, "_is_local", lambda files: local)
    assert [e.name for e in folders.entries(spark, str(root))] == ["run=b*c", "run=x{1}"]
    assert "epoch=99" in {e.name for e in folders.entries(spark, str(root / "run=b*c"))}
    assert not any(e.name.endswith(".crc") for e in folders.entries(spark, str(root / "run=b*c")))
    monkeypatch.setattr(folders, "_place", lambda *a: asked.append(a) or place(*a))
    gone = retention.expire_outputs(spark, str(root), keep=2)
    assert len(asked) < 10 and len(gone) == len(set(gone)) == 57 + 57 and all(p.startswith("file:/") for p in gone)
    assert sorted(str(p.relative_to(root)) for p in root.glob("*/epoch=*")) == [
        "run=b*c/epoch=57", "run=b*c/epoch=58", "run=b*c/epoch=59", "run=b*c/epoch=99",
        "run=x{1}/epoch=5", "run=x{1}/epoch=58", "run=x{1}/epoch=59"]


def test_what_a_job_has_saved_goes_with_it(spark):
    with job_folder(spark) as outer:
        kept = saved(spark.range(5), "rows")
        with job_folder(spark) as inner:
            assert inner.startswith(outer) and saved(kept, "more").count() == 5
        assert not folders.exists(spark, inner) and kept.count() == 5
    assert not folders.exists(spark, outer)
    with pytest.raises(RuntimeError), job_folder(spark) as failed:
        saved(spark.range(5), "rows")
        raise RuntimeError
    assert not folders.exists(spark, failed) and not scratch_path(spark, "x").startswith(outer)
