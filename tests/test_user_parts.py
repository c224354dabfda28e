"""Metrics and models of a user's own, samples by id, a manifest that grows, a wide probe."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polybag.operators import bags, batches, custom, scoring
from polybag.plans import datasets, evaluate, probe
from polybag.sources import folders, manifest, models, samples
from polybag.sources.batches import read_batches

EXAMPLES = "example_id bigint, part string, gt array<int>, pred array<int>, scores array<double>"


def evaluated(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        gt, pred = ([rng.randint(0, 1) for _ in range(3)] for _ in range(2))
        rows.append((i, rng.choice(["a", "b", None]), gt, pred, [rng.choice([0.1, 0.5, 0.9]) for _ in range(3)]))
    return rows, spark.createDataFrame(rows, EXAMPLES)


def losses_of(rows):
    hamming = np.mean([[g != p for g, p in zip(r[2], r[3])] for r in rows])
    return {"hamming_loss": hamming, "one_error": np.mean([1 - r[2][int(np.argmax(r[4]))] for r in rows])}


@pytest.mark.parametrize("partitions", [1, 7, 80])
def test_custom_metric_on_any_partitions(spark, partitions):
    rows, df = evaluated(spark)
    both = custom.Together(custom.HammingLoss(), custom.OneError())
    got = {r.metric: r.value for r in custom.custom_metric(df.repartition(partitions), both).collect()}
    assert got == pytest.approx(losses_of(rows))
    by_part = {(r.part, r.metric): r.value for r in custom.custom_metric(
        df.repartition(partitions), both, ["part"]).collect()}
    want = {(p, m): v for p in ("a", "b", None) for m, v in losses_of([r for r in rows if r[1] == p]).items()}
    assert by_part == pytest.approx(want)


def test_custom_metric_with_a_state_of_its_own(spark):
    class Span(custom.Metric):
        """Least and largest score; not a sum."""

        def clear(self):
            return None

        def update(self, state, gt, pred, scores):
            return self.merge(state, (float(scores.min()), float(scores.max())))

        def merge(self, state, other):
            if state is None or other is None:
                return state or other
            return min(state[0], other[0]), max(state[1], other[1])

        def evaluate(self, state):
            return {"least": None, "largest": None} if state is None else dict(zip(("least", "largest"), state))

    df = spark.createDataFrame([(1, "a", [1], [1], [0.25]), (2, "a", [0], [0], [0.75]), (3, "a", None, [0], [9.0])],
                               EXAMPLES).repartition(3)
    assert {r.metric: r.value for r in custom.custom_metric(df, Span()).collect()} == {"least": 0.25, "largest": 0.75}
    none = {r.metric: r.value for r in custom.custom_metric(df.limit(0), Span()).collect()}
    assert none == {"least": None, "largest": None}
    assert custom.custom_metric(df.limit(0), Span(), ["part"]).count() == 0


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    marks = str(tmp_path)
    name = models.ship_model(spark, {"weights": np.array([[1.0, 0.0], [0.0, 2.0]]), "bias": np.zeros(2)})

    def factory():
        with open(f"{marks}/{os.getpid()}", "a") as mark:
            mark.write("x")
        return models.linear_model(name)()

    rows = [(i, [i / 100, 1.0]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(40)
    scored = models.apply_model(df, factory, 2, batch_size=16)
    for _ in range(2):
        got = {r.id: r.scores for r in scored.collect()}
    loads = [open(f"{marks}/{f}").read() for f in os.listdir(marks)]
    assert loads and set(loads) == {"x"} and len(loads) <= 40
    assert all(got[i] == pytest.approx([1 / (1 + np.exp(-v[0])), 1 / (1 + np.exp(-2.0))]) for i, v in rows)


def test_rows_that_a_model_cannot_take(spark):
    name = models.ship_model(spark, {"weights": np.ones((2, 1)), "bias": np.zeros(1)})
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = {r.id: r.scores for r in models.apply_model(df, models.linear_model(name), 2).collect()}
    assert got == {1: [0.5], 2: None, 3: None, 4: None, 5: None}
    assert models.apply_model(df.limit(0), models.linear_model(name), 2).count() == 0


def test_samples_by_id_read_their_own_files(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [(i, f"row {i}", [float(i)]) for i in range(1_000)] + [(7, "again", [0.0]), (None, "no id", None)]
    df = spark.createDataFrame(rows, "id bigint, name string, vector array<double>")
    samples.write_samples(df, path, "id", 16)
    table = samples.read_samples(spark, path)
    assert table.schema == df.schema and table.count() == 1_002
    found = samples.fetch_samples(spark, path, "id", [7, 500, 500, 99_999])
    assert sorted((r.id, r.name) for r in found.collect()) == [(7, "again"), (7, "row 7"), (500, "row 500")]
    # The source has taken the filter: Spark is left with none of its own.
    assert "Filter (" not in found._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    # One partition for each file that may hold one of the ids.
    wanted = {samples.bucket_of(i, 16) for i in (7, 500, 99_999)}
    assert found.rdd.getNumPartitions() == len(wanted)
    assert [r.name for r in table.where("id = 3 AND name LIKE 'row%'").collect()] == ["row 3"]
    assert table.where("id = 3 AND id = 4").count() == 0 and table.where("id IS NULL").count() == 1
    assert samples.fetch_samples(spark, path, "id", []).count() == 0
    with pytest.raises(ValueError):
        samples.write_samples(df.withColumn("bucket", F.lit(1)), path, "id", 4)


def test_sample_reader_plans_the_files_of_the_ids(tmp_path, spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = samples.SampleReader(str(tmp_path), {"key": "id", "buckets": 8}, spark.range(1).schema)
    rest = list(reader.pushFilters([In(("id",), (1, 2, None)), GreaterThan(("id",), 0), EqualTo(("x",), 1)]))
    assert len(rest) == 2 and reader.ids == {1, 2}
    assert {p.number for p in reader.partitions()} == {samples.bucket_of(i, 8) for i in (1, 2)}
    list(reader.pushFilters([EqualTo(("id",), 2)]))
    assert [p.ids for p in reader.partitions()] == [(2,)]
    assert len(samples.SampleReader("", {"key": "id", "buckets": 8}, None).partitions()) == 8


def test_a_manifest_lists_only_what_is_new(spark, tmp_path):
    root, path = tmp_path / "images", str(tmp_path / "manifest")
    for sid, n in {"a": 3, "b": 0, "c": 2}.items():
        os.makedirs(root / sid)
        for i in range(n):
            (root / sid / f"{i}.jpg").write_bytes(b"x" * (i + 1))
    (root / "a" / "notes.txt").write_text("no image")
    listed = manifest.child_folders(spark, str(root))
    assert manifest.extend_manifest(listed, path, 1) == 3
    os.makedirs(root / "d")
    (root / "d" / "0.jpg").write_bytes(b"xyz")
    (root / "a" / "late.jpg").write_bytes(b"x")  # a folder already listed is not read again
    gone = spark.createDataFrame([(f"{root}/none",), (None,), (f"{root}/none",)], "folder string")
    again = manifest.child_folders(spark, str(root)).union(gone)
    assert manifest.extend_manifest(again, path, 2) == 2
    assert manifest.extend_manifest(again, path, 3) == 0
    got = sorted((r.sid, os.path.basename(r.path), r.length) for r in manifest.read_manifest(spark, path).collect())
    assert got == [("a", "0.jpg", 1), ("a", "1.jpg", 2), ("a", "2.jpg", 3), ("c", "0.jpg", 1), ("c", "1.jpg", 2),
                   ("d", "0.jpg", 3)]
    second = read_batches(spark, path, manifest.FILES).where("batch = 2")
    assert sorted(r.sid for r in second.collect()) == ["d", "none"]
    counts = {os.path.basename(r.folder): r.files for r in manifest.folder_counts(spark, path).collect()}
    assert counts == {"a": 3, "b": 0, "c": 2, "d": 1, "none": 0}
    assert folders.entries(spark, str(tmp_path / "nowhere")) == []


def test_a_probe_of_two_thousand_dimensions(spark):
    rng = np.random.default_rng(1)
    width = 2_048
    x = rng.normal(size=(400, width))
    y = (x[:, :3] > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), t.tolist()) for v, t in zip(x, y)],
                               "embedding array<double>, gt array<int>").repartition(6)
    ones = np.hstack([np.ones((400, 1)), x])
    got = probe._summed(df, "embedding", lambda a, _: a.T @ a).reshape(width + 1, width + 1)
    assert np.allclose(got, ones.T @ ones)
    weights, _ = probe.fit_probe(df, 3, iterations=8)
    assert np.shape(weights) == (3, width)
    for k in range(3):
        assert np.argmax(np.abs(weights[k])) == k
    assert ((x @ np.array(weights).T > 0) == (y == 1)).mean() > 0.95


def operators_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_collating_balances_once(spark):
    rows = [(b, p, f"{b}_{p}", [f"i{k}" for k in range(n)], n, [p % 2]) for b in range(3)
            for p, n in enumerate([5, 1, 3, 2])]
    batched = spark.createDataFrame(rows, "batch_id bigint, pos int, bag_id string, images array<string>, nslice int, "
                                          "gt array<int>")
    for part in batches.collate(batched, 5):
        assert "MapInPandas" not in operators_of(part)  # the order has been written


def test_pretraining_reads_the_catalogue_once(spark):
    images = spark.createDataFrame([(f"s{i % 7}", f"s{i % 7}/{i}", 20 + i % 3, 30) for i in range(140)],
                                   "sid string, path string, height int, width int")
    entities = spark.createDataFrame([(f"s{i}", [i % 2], "train") for i in range(7)],
                                     "sid string, gt array<int>, split string")
    rows = datasets.pretrain_samples(entities, images, batch_size=4)
    assert rows.count() == 140
    carried = bags.make_bags(images, 1, carry=("height", "width"))
    assert sorted((r.path, r.height, r.width) for r in carried.collect()) == sorted(
        (r.path, r.height, r.width) for r in images.collect())


@pytest.mark.parametrize("limit", [0, 100])
def test_scores_meet_their_bags_by_entity_and_path(spark, limit):
    images = spark.createDataFrame([(f"s{i % 5}", f"{i}") for i in range(100)], "sid string, path string")
    chosen = spark.createDataFrame([("s1",), ("s3",)], "sid string")
    scored = images.withColumn("scores", F.array(F.col("path").cast("double")))
    members = bags.make_bags(images.join(chosen, "sid"), 4)
    found = evaluate.instance_scores(members, scored, chosen, limit)
    assert sorted((r.sid, r.path, r.scores[0]) for r in found.collect()) == sorted(
        (f"s{i % 5}", str(i), float(i)) for i in range(100) if i % 5 in (1, 3))


def test_unmatched_examples(spark):
    left = spark.createDataFrame([(1, 1), (2, 0)], "k int, gt int")
    right = spark.createDataFrame([(2, 1), (3, 1)], "k int, pred int")
    assert [tuple(r) for r in scoring.align(left, right, "k").collect()] == [(2, 0, 1)]
    assert sorted(tuple(r) for r in scoring.unmatched(left, right, "k").collect()) == [(1, 1), (3, 2)]
