"""Cross-entropy and the contrastive loss against goldens and NumPy."""

import numpy as np
import pytest

from polybag.functions import l2_normalize
from polybag.operators import losses

VIEW_SCHEMA = "batch_id bigint, sample_id bigint, view string, embedding array<double>"


def _views(spark, x, y, z, batch=0):
    rows = [(batch, i, v, [float(c) for c in m[i]])
            for v, m in zip("xyz", (x, y, z)) for i in range(len(x))]
    return spark.createDataFrame(rows, VIEW_SCHEMA).repartition(4)


def _unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _numpy_terms(x, y, z, temp=0.1):
    def s(a, b):
        return np.exp(a @ b.T / temp)

    def own_rest(m):
        own = np.diagonal(m)
        return own, m.sum(axis=1) - own

    xy, rest = own_rest(s(x, y))
    rest = rest + own_rest(s(x, x))[1] + own_rest(s(y, y))[1]
    terms = [np.mean(-2 * np.log(xy / rest))]
    for a, b in ((x, z), (y, z), (z, x), (z, y)):
        own, others = own_rest(s(a, b))
        terms.append(np.mean(-np.log(own / others)))
    return terms


def test_bce_golden(spark):
    x, y = [.1, .2, .3, .5, .7, .9], [0, 1, 0, 0, 0, 1]
    w = [1.0, 2.0, 3.0, 4.0, 3.3, 2.2]
    cells = spark.createDataFrame(list(zip(x, y, w)), "score double, gt int, w double")
    assert losses.bce_loss(cells, "mean", weight="w").first()[0] == pytest.approx(1.895292, abs=1e-6)
    assert losses.bce_loss(cells, "sum", weight="w").first()[0] == pytest.approx(6 * 1.895292, abs=1e-5)
    assert losses.bce_loss(cells, "none").count() == 6


def test_bce_stays_finite_at_the_ends(spark):
    cells = spark.createDataFrame([(0.0, 1), (1.0, 0), (1.0, 1)], "score double, gt int")
    values = [r.bce for r in losses.bce_loss(cells, "none").collect()]
    assert all(np.isfinite(values)) and min(values) >= 0


def test_contrastive_golden(spark):
    eye = np.eye(2)
    row = losses.contrastive_loss(losses.anchor_similarities(_views(spark, eye, eye, eye))).first()
    assert row.mutual == pytest.approx(-17.802775, abs=1e-6)
    assert [row.aux_x, row.aux_y, row.aux_z_x, row.aux_z_y] == pytest.approx([-10.0] * 4)
    assert row.loss == pytest.approx(-57.802775, abs=1e-6)


def test_batch_of_one_is_null(spark):
    one = np.array([[1.0, 0.0]])
    row = losses.contrastive_loss(losses.anchor_similarities(_views(spark, one, one, one))).first()
    assert row.mutual is None and row.loss is None


@pytest.mark.parametrize("block", [512, 16])
def test_contrastive_equals_numpy(spark, block):
    rng = np.random.default_rng(3)
    big = [_unit(rng, 70, 8) for _ in range(3)]
    small = [_unit(rng, 9, 8) for _ in range(3)]
    views = _views(spark, *big).unionByName(_views(spark, *small, batch=1))
    rows = {r.batch_id: r for r in losses.contrastive_loss(
        losses.anchor_similarities(views, block=block)).collect()}
    for batch, triple in ((0, big), (1, small)):
        r = rows[batch]
        assert [r.mutual, r.aux_x, r.aux_y, r.aux_z_x, r.aux_z_y] == pytest.approx(
            _numpy_terms(*triple), abs=1e-10)


def test_every_anchor_meets_every_other_once(spark):
    rng = np.random.default_rng(4)
    views = _views(spark, *[_unit(rng, 50, 4) for _ in range(3)])
    sims = losses.anchor_similarities(views, block=8).collect()
    assert len(sims) == 50 and {r.others for r in sims} == {49}


def test_alignment_drops_incomplete_samples_and_stacks_back(spark):
    rng = np.random.default_rng(6)
    views = _views(spark, *[_unit(rng, 5, 3) for _ in range(3)])
    aligned = losses.align_views(views.where("NOT (sample_id = 2 AND view = 'z')"))
    assert sorted(r.sample_id for r in aligned.collect()) == [0, 1, 3, 4]
    assert losses.stack_views(losses.align_views(views)).exceptAll(views).isEmpty()


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1] == [None, None]
    rng = np.random.default_rng(7)
    raw = [5 * _unit(rng, 6, 3) for _ in range(3)]
    unit = losses.normalize_views(_views(spark, *raw))
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1.0) for r in unit.collect())
