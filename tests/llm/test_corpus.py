"""Quality, decontamination, near duplicates and the pipeline."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from polybag.llm import (
    components, op3_mixing, op6_quality, op9_decontamination, op10_simhash)
from polybag.llm.catalog import QUERIES
from polybag.llm.common import table
from polybag.sources import folders


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in op6_quality.quality_digest(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.9


def test_gradients():
    random = np.random.default_rng(0)
    x, owner, y = random.normal(size=(9, op6_quality.WIDTH)), np.array([0, 0, 1, 2, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    h, a = 5, 3
    w = {"encode": random.normal(size=(op6_quality.WIDTH, h)), "encode0": random.normal(size=h),
         "tanh": random.normal(size=(h, a)), "gate": random.normal(size=(h, a)),
         "attend": random.normal(size=a), "score": random.normal(size=h), "score0": random.normal(size=1)}

    def loss():
        s = op6_quality._forward(w, x, owner, 4)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in op6_quality._gradients(w, x, owner, y).items():
        flat = w[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 4)):
            flat[i] += 1e-6
            up = loss()
            flat[i] -= 2e-6
            down = loss()
            flat[i] += 1e-6
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 10)] * 2 + [(None, 1), (4, None), (999, 0)], "doc_id bigint, quality int")
    got = op6_quality.quality_digest(awkward, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = labels.limit(0)
    assert {r.score for r in op6_quality.quality_digest(awkward, none).collect()} == {0.5}
    assert op6_quality.quality_digest(nothing, labels).count() == 0
    kept = op6_quality.good_documents(awkward, none)
    assert kept.columns == awkward.columns and kept.count() == 11


def index_of(items):
    said = [(i, op9_decontamination.tokens(text)) for i, text in items]
    held = Counter(t for _, words in said for t in set(words))
    mean = sum(len(words) for _, words in said) / len(said)
    return op9_decontamination.build_index([
        (i, words, op9_decontamination.term_weights(words, held, len(said), mean)) for i, words in said])


def brute_leaks(items, text):
    """{item: score} of all items in all passages, without index, blocks or cursors."""
    k1, b, cut_at = 1.2, 0.75, re.compile("[^0-9a-z\x80-\U0010ffff]+")

    def split(t):
        return [w for w in cut_at.split(t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]

    said = [(i, split(t)) for i, t in items if split(t)]
    held = Counter(t for _, words in said for t in set(words))
    mean, out, words = np.mean([len(w) for _, w in said]), {}, split(text)
    half = max(len(w) for _, w in said)
    for first in range(max(1, -(-(len(words) - half) // half))):
        passage = words[first * half:(first + 2) * half]
        runs = {tuple(passage[i:i + 3]) for i in range(len(passage) - 2)}
        for i, own in said:
            weight = {t: math.log(1 + (len(said) - held[t] + .5) / (held[t] + .5)) * n * (k1 + 1)
                      / (n + k1 * (1 - b + b * len(own) / mean)) for t, n in Counter(own).items()}
            score = sum(w for t, w in weight.items() if t in set(passage)) / sum(weight.values())
            if len(own) < 3:
                found = words == own
            elif len(own) < 6:
                found = any(passage[k:k + len(own)] == own for k in range(len(passage)))
            else:
                cut = len(own) - max(1, len(own) // 3)
                parts = [{tuple(p[k:k + 3]) for k in range(len(p) - 2)} or {tuple(p)} for p in (own[:cut], own[cut:])]
                short = runs | {tuple(passage[k:k + n]) for n in (1, 2) for k in range(len(passage) - n + 1)}
                found = all(len(p & short) / len(p) >= 0.5 for p in parts)
            if found and score >= 0.6 - 1e-9:
                out[i] = max(out.get(i, 0), score)
    return out


def test_wand_retrieves_what_scoring_all_does():
    random.seed(2)
    vocabulary = [f"w{int(random.expovariate(0.02))}" for _ in range(2000)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(3, 40)))) for i in range(150)]
    index = index_of(items)
    for _ in range(200):
        words = random.choices(vocabulary, k=40) + random.choice(items)[1].split()[:random.randint(0, 40)]
        terms = np.unique([index.terms.get(t.encode(), 0) for t in words])
        score = defaultdict(float)
        for t in terms:
            for item, weight in index.postings[t]:
                score[item] += weight
        got = op9_decontamination.wand(index, terms[terms > 0], np.arange(index.bounds.shape[1]))
        assert {i for i, _ in got} == {i for i, s in score.items() if s >= 1 - 1e-9}


def test_leaks_against_scoring_every_passage(spark, docs_of):
    random.seed(12)
    vocabulary = [f"w{int(random.expovariate(0.03))}" for _ in range(900)] + ["Ünï", "漢字"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 2, 3, 5, 6, 12, 30])))) for i in range(90)]
    texts = []
    for i, item in random.choices(items, k=120):
        said = item.split()
        for _ in range(random.choice([0, 0, 1, len(said) // 4])):
            said[random.randrange(len(said))] = random.choice(vocabulary)
        around = [random.choices(vocabulary, k=random.choice([0, 0, 20, 150])) for _ in range(2)]
        texts.append(" ".join(around[0] + said[:random.choice([len(said), len(said), len(said) // 2])] + around[1]))
    docs = docs_of([(i, t, "s") for i, t in enumerate(texts)])
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i): s for d, t in enumerate(texts) for i, s in brute_leaks(items, t).items()}
    got = {(r.doc_id, r.item_id): r.score for r in op9_decontamination.leak_digest(docs, tests).collect()}
    assert got == pytest.approx(want) and 30 < len(want)
    assert {len(items[i][1].split()) for _, i in want} >= {3, 5, 6, 12, 30}


def test_a_hundred_shards(spark, docs_of):
    """The shards change where passages are cut, and nothing else."""
    random.seed(13)
    items = [(i, " ".join(f"q{random.randint(0, 5000)}" for _ in range(20))) for i in range(300)]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of([(i, "before it " * 30 + items[i][1] + " and after" * 30, "s") for i in range(0, 300, 3)])
    path = op9_decontamination.write_index(tests, shard_items=3)
    shards = [e for e in folders.entries(spark, path) if e.name.startswith("shard=")]
    assert len(shards) == 100
    by_bytes = [e for e in folders.entries(spark, op9_decontamination.write_index(tests, shard_bytes=1_000))
                if e.name.startswith("shard=")]
    assert len(by_bytes) > 20
    one, many = ({(r._row.doc_id, x.item_id, round(x.score, 9)) for r in op9_decontamination.with_leaks(
        docs, tests, **limits).collect() for x in r.leaks} for limits in ({}, {"shard_items": 3}))
    assert one == many and {(d, i) for d, i, _ in one} == {(i, i) for i in range(0, 300, 3)}


def test_short_items(spark, docs_of):
    tests = spark.createDataFrame([(1, "yes"), (2, "two words"), (3, "who is there"), (4, "a b c d e f")],
                                  "item_id bigint, text string")
    docs = docs_of([(1, "Yes.", "s"), (2, "oh yes it is", "s"), (3, "He asked: Who is there?", "s"),
                    (4, "is who there", "s"), (5, "Two words", "s"), (6, "two words more", "s"), (7, "x a b c d e f y", "s")])
    got = {(r.doc_id, r.item_id) for r in op9_decontamination.leak_digest(docs, tests).collect()}
    assert got == {(1, 1), (3, 3), (5, 2), (7, 4)}


def test_leaks(spark, docs_of, nothing):
    random.seed(7)
    word = lambda: f"v{random.randint(0, 800)}"
    items = [(i, " ".join(word() for _ in range(random.randint(15, 60)))) for i in range(60)]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{filler(random.randint(0, 700))} {items[i][1].upper()}. {filler(100)}", "s") for i in range(40)]
    rows += [(100 + i, filler(500), "s") for i in range(40)] + [(200, None, "s"), (201, "", "s")]
    rows += [(202, " ".join(items[3][1].split()[:9]) + filler(60), "s"), (0, rows[0][1], "s")]
    tests = spark.createDataFrame(items + [(None, None), (77, ""), (0, items[0][1])], "item_id bigint, text string")
    docs = docs_of(rows, clash=True)
    got = {(r.doc_id, r.item_id) for r in op9_decontamination.leak_digest(docs, tests).collect()}
    assert got == {(i, i) for i in range(40)}
    few = op9_decontamination.with_leaks(docs, tests, shard_items=7)
    assert {(r._row.doc_id, x.item_id) for r in few.collect() for x in r.leaks} == got
    kept = op9_decontamination.decontaminate(docs, tests)
    assert kept.columns == docs.columns and kept.count() == 43
    assert op9_decontamination.leak_digest(docs, tests.limit(0)).count() == 0
    assert op9_decontamination.leak_digest(nothing, tests).count() == 0


def brute_components(marks):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [512, 6])
def test_links_against_brute_force(spark, block):
    random.seed(1)
    marks = [random.getrandbits(64) for _ in range(200)]
    for m in random.choices(marks, k=30):
        for _ in range(30):
            flips = random.sample(range(64), random.randint(1, 5))
            marks.append(m ^ sum(1 << b for b in flips))
    marks += [0, 1, 7, 15, (1 << 64) - 1, 1 << 63]
    marks = list(dict.fromkeys(marks))
    rows = [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "doc_id bigint, mark bigint")
    got = {r.doc_id: r.component_id for r in op10_simhash.with_components(df, block).collect()}
    groups = defaultdict(list)
    for i, r in enumerate(brute_components(marks)):
        groups[r].append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}


def test_simhash_digest(spark, sf_dir, awkward, nothing):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in op10_simhash.simhash_digest(docs).collect()}
    rows = docs.orderBy("doc_id").collect()
    marks = [brute_simhash(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{m:016x}" for m in marks]
    least = {}
    roots = brute_components(marks)
    for r, root in zip(rows, roots):
        least.setdefault(root, r.doc_id)
    assert [got[r.doc_id].component_id for r in rows] == [least[root] for root in roots]
    odd = op10_simhash.simhash_digest(awkward).collect()
    assert len(odd) == 11 and {r.component_id for r in odd if r.fingerprint == "0" * 16} == {1}
    assert op10_simhash.simhash_digest(nothing).count() == 0


def test_components(spark):
    random.seed(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(5, 2), (2, 9), (9, 5), (7, 7), (40, 41)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 2: 2, 5: 2, 9: 2, 40: 40, 41: 40}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def staying(rows):
    """Of (id, text) rows, those that stay by comparing all fingerprints with each other."""
    roots, first = brute_components([brute_simhash(text) for _, text in rows]), {}
    for root, (i, text) in zip(roots, rows):
        key = (i is None, i or 0, hashlib.md5((text or "").encode()).hexdigest()), i, text
        first[root] = min(first.get(root, key), key, key=lambda k: k[0])
    return Counter((i, text) for _, i, text in first.values())


def stayed(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_one_document_of_each_group_stays(docs_of):
    random.seed(5)
    rows = []
    for _ in range(50):
        base = [f"n{random.randint(0, 3000)}" for _ in range(random.randint(3, 400))]
        rows.append((" ".join(base)))
        for _ in range(random.randint(0, 6)):
            near = list(base)
            for _ in range(random.randint(0, 2)):
                near[random.randrange(len(near))] = "edited"
            rows.append(" ".join(near))
    rows += ["", None, "one", "ONE", " one "]
    ids = random.sample(range(10_000), len(rows) - 1) + [None]
    docs = docs_of([(i, text, "s") for i, text in zip(ids, rows)], clash=True)
    kept = op10_simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = staying(list(zip(ids, rows)))
    assert stayed(kept) == want and 50 <= sum(want.values()) < len(rows)


def test_dropping_near_duplicates_of_awkward_rows(docs_of, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    kept = op10_simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and stayed(kept) == staying(rows)
    unknown = [(None, f"a text{i} without id{i}", "s") for i in range(4)] * 2
    assert op10_simhash.drop_near_duplicates(docs_of(unknown)).count() == 4
    assert op10_simhash.drop_near_duplicates(nothing).count() == 0
    # Rows that repeat id and text: the same one stays however they are cut into partitions.
    again = docs_of([(1, "a b c d", s) for s in "zyxw"] * 3 + [(2, "e f g h", "q")])
    found = {tuple(sorted((r.doc_id, r.source) for r in op10_simhash.drop_near_duplicates(
        again.repartition(n)).collect())) for n in (1, 5, 12)}
    assert len(found) == 1


def test_stage_keeps_what_comparing_all_fingerprints_keeps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert stayed(kept) == staying([(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard"]
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(texts[r.doc_id] == r.text for r in rows)
    # What the stages leave, recounted from their rules.
    labels = table(spark, sf_dir, "labels")
    good = {r.doc_id for r in op6_quality.good_documents(docs, labels).collect()}
    leaks = {r.doc_id for r in op9_decontamination.leak_digest(docs, table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in rows} <= good - leaks
    assert len({r.text for r in rows}) == len({r.doc_id for r in rows})
    assert {r.shard for r in rows} <= set(range(40))


def test_stages_take_awkward_rows(spark, sf_dir, awkward, nothing, tmp_path):
    for docs, least in ((awkward, 1), (nothing, 0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if name != "sharding":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{least}-{k}")
            assert spark.read.parquet(f"{tmp_path}/{least}-{k}").count() >= least * (name != "quality"), name


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert op3_mixing.CAP == 3.0
