"""Bags and batches, with and without heavy entities."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polybag.operators import bags, batches, views
from polybag.operators.skew import find_heavy, rank_within, sorted_rank, spread_join
from polybag.plans import datasets

SIZES = {"a": 3, "b": 20, "c": 21, "d": 25, "e": 59, "f": 173, "g": 1}


@pytest.fixture(scope="module")
def images(spark):
    rows = [(s, f"{s}/{i}.jpg") for s, n in SIZES.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:40], "sid string, path string").repartition(5)


@pytest.mark.parametrize("n,size,full,left", [
    (3, 3, 1, 0), (20, 20, 1, 0), (21, 10, 2, 1), (25, 12, 2, 1), (39, 19, 2, 1), (41, 20, 2, 1),
    (45, 11, 4, 1), (50, 12, 4, 2), (59, 14, 4, 3), (173, 10, 17, 3)])
def test_bag_sizes(spark, n, size, full, left):
    row = bags.bag_sizes(spark.createDataFrame([("s", n)], "sid string, n_images bigint"), 20).first()
    assert (row.bag_size, row.full_bags, row.leftover) == (size, full, left)


def test_halving_matches_a_loop(spark):
    rows = bags.bag_sizes(spark.range(1, 4000).selectExpr("id AS sid", "id AS n_images"), 20)
    for r in rows.collect():
        b = r.n_images
        while b > 20:
            b //= 2
        assert r.bag_size == b


def _layout(members):
    found = defaultdict(dict)
    for r in members.collect():
        found[r.sid][(r.bag_no, r.instance_no)] = r.path
        assert r.bag_id == f"{r.sid}_{r.bag_no}"
    return found


def test_bags_partition_the_images(images):
    for sid, places in _layout(bags.make_bags(images, 20)).items():
        n, b = SIZES[sid], SIZES[sid]
        while b > 20:
            b //= 2
        assert len(set(places.values())) == n
        assert sorted(places) == [(i // b, i % b) for i in range(n)]


def test_heavy_entities_get_the_same_bags(images):
    plain = _layout(bags.make_bags(images, 20))
    split = _layout(bags.make_bags(images, 20, heavy_rows=10))
    assert plain == split


def test_a_long_list_of_heavy_keys_is_joined_by_a_shuffle(images):
    heavy = find_heavy(images, "sid", heavy_rows=2, limit=2)
    every = find_heavy(images, "sid", heavy_rows=2)
    assert heavy.rows == 2 and not heavy.broadcast and every.broadcast
    assert sorted(heavy.frame.collect()) == sorted(every.frame.collect())
    plain = _layout(bags.make_bags(images, 20))
    assert _layout(bags.make_bags(images, 20, heavy_rows=2, heavy=heavy)) == plain


def test_a_null_group_is_split_like_others(spark):
    rows = spark.range(1200).selectExpr("if(id < 1000, null, concat('k', id % 3)) AS g", "id AS k")
    plain = {r.k: (r.rank, r.n) for r in rank_within(rows, "g", "k").collect()}
    split = rank_within(rows, "g", "k", heavy_rows=50)
    assert {r.k: (r.rank, r.n) for r in split.collect()} == plain
    assert max(n for _, n in plain.values()) == 1000


def test_rank_within_one_group_holding_nearly_all(spark):
    rows = spark.range(5000).selectExpr("if(id < 4900, 'hot', concat('k', id)) AS g", "id AS k")
    plain = {r.k: (r.rank, r.n) for r in rank_within(rows, "g", "k").collect()}
    split = {r.k: (r.rank, r.n) for r in rank_within(rows, "g", "k", heavy_rows=50).collect()}
    assert plain == split
    assert sorted(v[0] for k, v in plain.items() if k < 4900) == list(range(4900))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) AS k", "id AS v")
    unique = spark.range(40).selectExpr("id AS k", "id * 2 AS w")
    plain = rows.join(unique, "k", how)
    salted = spread_join(rows, unique, "k", "v", how, heavy_rows=100)
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain.select(*salted.columns)).isEmpty()


def test_labels_join_bags_of_a_heavy_entity(spark, images):
    labels = spark.createDataFrame([(s, [1, 0]) for s in SIZES], "sid string, gt array<int>")
    members = bags.make_bags(images, 20)
    plain = bags.label_bags(bags.bag_table(members), labels)
    salted = bags.label_bags(bags.bag_table(members), labels, heavy_rows=3)
    assert plain.count() == salted.count() == bags.bag_lengths(members).count()


def test_missing_images(spark, images):
    sids = spark.createDataFrame([("a",), ("zz",)], "sid string")
    assert [r.sid for r in bags.missing_images(sids, images).collect()] == ["zz"]


def test_sorted_rank_is_the_text_order(spark):
    rows = spark.range(1200).selectExpr("concat('g_', id) AS bag_id")
    ranked = {r.bag_id: r.rank for r in sorted_rank(rows, "bag_id").collect()}
    assert [ranked[k] for k in sorted(ranked)] == list(range(1200))
    assert ranked["g_10"] < ranked["g_2"]


@pytest.mark.parametrize("order", ["lexical", "shuffled"])
def test_last_partial_batch_is_dropped(spark, order):
    table = spark.range(30).selectExpr("concat('b', id) AS bag_id", "cast(id % 5 + 1 AS int) AS nslice")
    rows = batches.assign_batches(table, 8, order).collect()
    assert Counter(r.batch_id for r in rows) == {0: 8, 1: 8, 2: 8}
    if order == "lexical":
        ids = [r.bag_id for r in sorted(rows, key=lambda r: (r.batch_id, r.pos))]
        assert ids == sorted(f"b{i}" for i in range(30))[:24]


def test_offsets_and_padding(spark):
    table = spark.createDataFrame(
        [(0, 0, "a", 2, ["p", "q"]), (0, 1, "b", 3, ["r", "s", "t"]), (0, 2, "c", 1, ["u"])],
        "batch_id bigint, pos int, bag_id string, nslice int, images array<string>")
    assert [r.offset for r in batches.segment_offsets(table).orderBy("pos").collect()] == [0, 2, 5]
    assert [r.padded for r in bags.pad_bags(table).orderBy("pos").collect()] == [
        ["p", "q", ""], ["r", "s", "t"], ["u", "", ""]]
    stats = batches.batch_stats(table).first()
    assert (stats.n_bags, stats.n_instances, stats.max_slice) == (3, 6, 3)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_halves_are_optimal(sizes):
    order = batches.halves(sizes)
    half = len(sizes) // 2
    assert sorted(order) == list(range(len(sizes)))
    picked = sum(sizes[i] for i in order[:half])
    best = max(s for s in (sum(c) for c in itertools.combinations(sizes, half))
               if s <= sum(sizes) // 2)
    assert picked == best


@pytest.mark.parametrize("sizes,best", [([20, 3, 10, 7], 17), ([5, 5, 5, 5], 10),
                                        ([1, 2, 3, 4, 5], 7)])
def test_balanced_halves(spark, sizes, best):
    assert sum(sizes[i] for i in batches.halves(sizes)[:len(sizes) // 2]) == best
    table = spark.createDataFrame(
        [(7, i, f"b{i}", s) for i, s in enumerate(sizes)],
        "batch_id bigint, pos int, bag_id string, nslice int")
    rows = batches.balance_batches(table).orderBy("pos").collect()
    assert sum(r.nslice for r in rows if r.half == 0) == best
    assert [r.half for r in rows] == sorted(r.half for r in rows)


def test_dataset_modes(spark, images):
    labels = spark.createDataFrame(
        [(s, "x;y" if i % 2 else "x", i) for i, s in enumerate(SIZES)],
        "sid string, label string, ord bigint")
    entities, _ = datasets.entity_table(labels, 2)
    by_split = {r.sid: r.split for r in entities.collect()}
    table = datasets.labelled_bags(entities, images, "test")
    assert {r.sid for r in table.collect()} == {s for s, v in by_split.items() if v == "test"}
    assert table.agg(F.max("nslice")).first()[0] <= 20
    train = datasets.bag_samples(entities, images, "train", batch_size=1)
    n_train = sum(n for s, n in SIZES.items() if by_split[s] == "train")
    assert train.count() == n_train
    sized = images.selectExpr("*", "300 AS height", "400 AS width")
    rows = datasets.pretrain_samples(entities, sized, batch_size=1).collect()
    assert len(rows) == n_train
    assert all(len(r.img_aux.ops) == 2 and not r.img_basic1.ops for r in rows)
    # The plan of the sample is the plan of the image.
    planned = {(r.path, r.view): r for r in views.view_plan(sized, key="path").collect()}
    for r in rows:
        for view in views.PRETRAIN_VIEWS:
            plan, whole = r[f"img_{view}"], planned[r.image_id, view]
            assert all(plan[f] == whole[f] for f in whole.asDict() if f != "path")
    heavy = datasets.labelled_bags(entities, images, "test", heavy_rows=15)
    assert sorted(r.bag_id for r in heavy.collect()) == sorted(r.bag_id for r in table.collect())


def test_collated_batches(spark):
    table = spark.createDataFrame(
        [(7, 0, "a", ["a0", "a1", "a2"], 3, [1, 0]), (7, 1, "b", ["b0"], 1, [0, 1]),
         (8, 0, "c", ["c0", "c1", "c2", "c3"], 4, [1, 1])],
        "batch_id bigint, pos int, bag_id string, images array<string>, nslice int, gt array<int>")
    instances, bag_rows = batches.collate(table, 4)
    # Halves of batch 7: b within the limit of 2, then a.
    want = [(7, 0, "b", "b0", [0, 1]), (7, 1, "a", "a0", [1, 0]), (7, 2, "a", "a1", [1, 0]),
            (7, 3, "a", "a2", [1, 0])]
    want += [(7, i, None, None, [0, 0]) for i in range(4, 8)]
    want += [(8, i, "c", f"c{i}", [1, 1]) for i in range(4)]
    assert [tuple(r) for r in instances.orderBy("batch_id", "row_no").collect()] == want
    assert [tuple(r) for r in bag_rows.orderBy("batch_id", "pos").collect()] == [
        (7, 0, "b", 1, 0, [0, 1]), (7, 1, "a", 3, 1, [1, 0]), (8, 0, "c", 4, 0, [1, 1])]
    plain, _ = batches.collate(table, 4, per_instance=False)
    assert plain.columns == ["batch_id", "row_no", "bag_id", "path"] and plain.count() == 12
