"""Every registered query against its SQL on the smallest tables, and the plans' promises."""

import re

import numpy as np
import pytest

import check_oracle
import __spark_entry__ as entry
from polybag.catalog.queries import QUERIES
from polybag.operators import auc, bags, metrics, scoring
from polybag.plans import probe
from polybag.catalog import tables as t
from polybag.session import shared_dir


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracle.duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in entry.oracle_sql():
        verdict, rows = check_oracle.compare(df, con, entry.oracle_sql()[name])
        assert verdict == "ok", verdict
    else:
        rows = df.count()
    assert rows > 0


def test_only_the_expected_queries_lack_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == {
        "augment_views", "render_views", "linear_probe"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_probe_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    gt = np.stack([x[:, 0] > 0, x[:, 1] + x[:, 2] > 0.5], axis=1).astype(int)
    rows = spark.createDataFrame(
        [(i, v.tolist(), g.tolist()) for i, (v, g) in enumerate(zip(x, gt))],
        "id bigint, embedding array<double>, gt array<int>")
    weights, intercepts = probe.fit_probe(rows.where("id < 300"), 2)
    assert weights[0][0] > abs(weights[0][1]) and intercepts[1] < 0
    scored = scoring.apply_scorer(rows.where("id >= 300"), probe.probe_scorer(weights, intercepts))
    assert auc.both_aucs(scored).first().sk_auc_macro > 0.95


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = _plan(bags.image_counts(t.event_images(spark, sf_dir)))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan)[-1] == "event_id:bigint,user_id:bigint"


def test_confusion_counts_need_one_small_shuffle(spark, sf_dir):
    rows = spark.createDataFrame([(0, [1, 0], [1, 1])], "e bigint, gt array<int>, pred array<int>")
    plan = _plan(metrics.confusion_counts(rows))
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan


def test_no_operator_crosses(spark, sf_dir):
    plan = _plan(auc.both_aucs(t.vector_scores(spark, sf_dir)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
