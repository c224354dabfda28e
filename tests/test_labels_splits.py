"""Label tables and splits: the miniature label file, ties, duplicates, proportions."""

import hashlib
from collections import Counter

import pytest

from polybag.operators import labels as lab
from polybag.operators import splits
from polybag.operators.skew import hashed_rank
from polybag.plans import datasets
from polybag.sources.labels import scan_labels

MINI = [("g1", "7;6", 0), ("g2", "6", 1), ("g3", "9;7", 2), ("g2", "5", 3)]


@pytest.fixture(scope="module")
def mini(spark):
    return spark.createDataFrame(MINI, "sid string, label string, ord bigint").repartition(3)


def test_frequency_counts_repeated_rows(mini):
    assert {r.code: r.n for r in lab.label_frequency(mini).collect()} == {
        "7": 2, "6": 2, "9": 1, "5": 1}


def test_vocabulary_breaks_ties_by_first_appearance(mini):
    assert lab.vocabulary_codes(lab.top_labels(mini, 4)) == ["7", "6", "9", "5"]


def test_repeated_code_in_first_row_keeps_its_first_place(spark):
    rows = spark.createDataFrame(
        [("a", "x;y;z;x", 0), ("b", "y", 1), ("c", "z", 2)],
        "sid string, label string, ord bigint")
    assert lab.vocabulary_codes(lab.top_labels(rows, 3)) == ["x", "y", "z"]


def test_last_row_wins(mini):
    assert {r.sid: r.label for r in lab.latest_labels(mini).collect()} == {
        "g1": "7;6", "g2": "5", "g3": "9;7"}


def test_filter_keeps_row_order_and_drops_empty(mini):
    codes = lab.vocabulary_codes(lab.top_labels(mini, 2))
    kept = lab.filter_top_labels(lab.latest_labels(mini), codes)
    assert {r.sid: r.codes for r in kept.collect()} == {"g1": ["7", "6"], "g3": ["7"]}


def test_encoding_follows_the_vocabulary(mini):
    kept = lab.filter_top_labels(lab.latest_labels(mini), ["7", "6", "9"])
    encoded = lab.encode_labels(kept, ["7", "6", "9"])
    assert {r.sid: r.gt for r in encoded.collect()} == {"g1": [1, 1, 0], "g3": [1, 0, 1]}
    assert lab.long_annotations(encoded).count() == 6


def test_vocabulary_check(mini):
    row = lab.vocabulary_check(lab.top_labels(mini, 9), 9).first()
    assert (row.requested_k, row.found_k, row.too_few) == (9, 4, 1)


def test_scan_keeps_single_codes_as_text(spark, tmp_path):
    path = tmp_path / "labels.csv"
    rows = [(f"g{i:05d}", ";".join(str((i * 7 + j) % 27) for j in range(1 + i % 4)))
            for i in range(2000)]
    path.write_text("Gene,label\n" + "\n".join(f"{g},{v}" for g, v in rows) + "\n")
    table = scan_labels(spark, str(path))
    assert [(r.sid, r.label) for r in table.orderBy("ord").collect()] == rows
    counted = Counter(c for _, v in rows for c in v.split(";"))
    assert lab.vocabulary_codes(lab.top_labels(table, 27)) == [
        c for c, _ in counted.most_common(27)]


def test_files_of_a_folder_are_read_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gene,label\ng1,1\n")
    (tmp_path / "b.csv").write_text("Gene,label\n" + "".join(f"g{i},{i}\n" for i in range(500)) + "g1,9\n")
    table = scan_labels(spark, str(tmp_path))
    assert {r.sid: r.label for r in lab.latest_labels(table).collect()}["g1"] == "9"
    assert [r.ord for r in table.orderBy("ord").collect()] == list(range(502))
    assert table.orderBy("ord").first().label == "1"


@pytest.mark.parametrize("separator", ["||", "^", ".", "]", "\\", "-", ";"])
def test_separators_are_literal(spark, separator):
    row = spark.createDataFrame([("s", f"a{separator}b|c{separator}d", 0)], "sid string, label string, ord bigint")
    assert [r.code for r in lab.explode_labels(row, separator).collect()] == ["a", "b|c", "d"]


@pytest.mark.parametrize("n,sizes", [(1487, (594, 149, 744)), (1600, (640, 160, 800)),
                                     (1, (0, 0, 1)), (7, (2, 1, 4))])
def test_split_sizes_are_exact(spark, n, sizes):
    sids = spark.range(n).selectExpr("concat('g', id) AS sid")
    found = Counter(r.split for r in splits.split_assign(sids).collect())
    assert (found["train"], found["val"], found["test"]) == sizes


def test_seeded_order_is_the_hash_order(spark):
    sids = spark.range(500).selectExpr("concat('g', id) AS sid")
    ranked = {r.sid: r.rank for r in splits.seeded_order(sids, digits=2).collect()}
    expected = sorted(ranked, key=lambda s: (
        hashlib.md5(f"{splits.SPLIT_SEED}:{s}".encode()).hexdigest(), s))
    assert [ranked[s] for s in expected] == list(range(500))


def test_modes_share_a_split_without_overlap(spark, mini):
    rows = spark.createDataFrame(
        [(f"g{i}", "a;b" if i % 2 else "a", i) for i in range(50)],
        "sid string, label string, ord bigint")
    entities, codes = datasets.entity_table(rows, 2)
    assert codes == ["a", "b"]
    parts = {m: {r.sid for r in splits.in_split(entities, m).collect()}
             for m in ("pretrain", "train", "val", "test")}
    assert parts["pretrain"] == parts["train"]
    assert len(parts["train"]) == 20 and len(parts["val"]) == 5 and len(parts["test"]) == 25
    assert len(parts["train"] | parts["val"] | parts["test"]) == 50
    summary = {r.split: r for r in splits.split_summary(entities, 8).collect()}
    assert summary["train"].n_batches == 2 and summary["test"].n_batches == 3


def test_order_is_the_same_for_any_number_of_pieces(spark):
    sids = spark.range(3000).selectExpr("concat('g', id) AS sid")
    orders = [{r.sid: r.rank for r in splits.seeded_order(sids, digits=d).collect()} for d in (1, 3, None)]
    assert orders[0] == orders[1] == orders[2]
    many = hashed_rank(sids, "sid", seed=splits.SPLIT_SEED, piece_rows=0.1)
    assert {r.sid: r.rank for r in many.collect()} == orders[0]
