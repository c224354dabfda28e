"""Mixing, sharding, licences, fingerprints and repeated passages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from polybag.llm import (
    op3_mixing, op4_fingerprints, op5_substrings, op7_sharding, op8_license_scans)
from polybag.llm.common import table


def fill(sizes, weights, cap=3.0):
    """Targets by the definition: deal what is left by weight until nobody is above the cap."""
    targets, fixed = {}, {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        total = sum(weights[s] for s in free)
        targets = {s: left * weights[s] / total if total else 0 for s in free}
        above = [s for s in free if targets[s] > cap * sizes[s]]
        if not above:
            return {**targets, **fixed}
        fixed.update({s: cap * sizes[s] for s in above})


def test_targets(docs_of):
    sizes = {"a": 5, "b": 400, "c": 100, "d": 7, "e": 0, "é": 60, None: 900}
    docs = docs_of([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {r.source: r.target for r in op3_mixing.mix_digest(docs).join(
        docs.select("doc_id", "source"), "doc_id").collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: op3_mixing.WEIGHTS[i % 3] for i, s in enumerate(order)})
    assert got == pytest.approx(want)


def test_mix_takes_what_it_says(docs_of):
    random.seed(1)
    docs = docs_of([(i, "w " * random.randint(0, 40), f"s{i % 4}") for i in range(3000)], clash=True)
    digest = op3_mixing.mix_digest(docs).collect()
    assert digest == op3_mixing.mix_digest(docs.repartition(3)).orderBy("doc_id").collect() or (
        sorted(digest) == sorted(op3_mixing.mix_digest(docs.repartition(3)).collect()))
    mixed = Counter(r.doc_id for r in op3_mixing.mix(docs).collect())
    for r in digest:
        assert r.taken == r["size"] * mixed[r.doc_id] <= 3 * r["size"] or r["size"] == 0
    for source in range(4):
        own = [r for r in digest if r.doc_id % 4 == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.1)
    assert op3_mixing.mix(docs).columns == docs.columns


def test_awkward_rows(awkward, nothing):
    assert op3_mixing.mix_digest(awkward).count() == op7_sharding.shard_digest(awkward).count() == 11
    assert op8_license_scans.license_digest(awkward).count() == 11
    assert op4_fingerprints.fingerprint_digest(awkward).count() == 11
    assert op5_substrings.substring_digest(awkward).count() == 11
    sharded = op7_sharding.shard_documents(awkward)
    assert sharded.columns == [*(c for c in awkward.columns if c != "shard"), "shard"]
    assert sharded.where("shard between 0 and 39").count() == 11
    for digest in (op3_mixing.mix_digest, op7_sharding.shard_digest, op8_license_scans.license_digest,
                   op4_fingerprints.fingerprint_digest, op5_substrings.substring_digest):
        assert digest(nothing).count() == 0


def test_difference_is_a_partition_and_tight():
    random = np.random.default_rng(2)
    sums = np.zeros((3000, 40))
    sums[:, -1] = random.integers(16, 20_000, 3000)
    home = op7_sharding.difference(sums)
    assert (np.sort(home, axis=1) == np.arange(40)).all()
    shards = np.bincount(home[:, -1], sums[:, -1], 40)
    assert shards.max() - shards.min() <= 20
    assert (op7_sharding.difference(sums[:1]) >= 0).all() and op7_sharding.difference(sums[:0]).shape == (0, 40)


def test_levels_balance(docs_of):
    random.seed(5)
    docs = docs_of([(i, "é" * random.randint(0, 900) + str(i % 900), "s") for i in range(4000)])
    rows = op7_sharding.shard_rows(docs, shards=7, piece=50, run=100).collect()
    bytes_of = Counter()
    for r in rows:
        bytes_of[r.shard] += r["size"]
    assert set(bytes_of) == set(range(7)) and max(bytes_of.values()) - min(bytes_of.values()) < 4000
    texts = {r.doc_id: r.text for r in docs.collect()}
    homes = {}
    for r in rows:
        text = texts[r.doc_id].encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
        assert homes.setdefault(text, r.shard) == r.shard
    for shard in range(7):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(
            sum(r.shard == shard for r in rows)))


def plain_differencing(sizes, parts):
    """Partitions as sorted lists of sums, the two of largest spread combined until one is left."""
    found = [(i, sorted([size] + [0] * (parts - 1))) for i, size in enumerate(sizes)]
    fresh = len(found)
    while len(found) > 1:
        found.sort(key=lambda p: (p[1][0] - p[1][-1], p[0]))
        (_, a), (_, b), *rest = found
        found = [*rest, (fresh, sorted(x + y for x, y in zip(a, reversed(b))))]
        fresh += 1
    return found[0][1]


@pytest.mark.parametrize("parts", [2, 3, 7, 40])
def test_differencing_against_a_plain_one(parts):
    random.seed(parts)
    for n in (1, 2, 5, 60, 200):
        sizes = [random.choice([1, 7, random.randint(1, 10_000)]) for _ in range(n)]
        sums = np.zeros((n, parts))
        sums[:, -1] = sizes
        home = op7_sharding.difference(sums)
        assert all(sorted(row) == list(range(parts)) for row in home)
        got = np.bincount(home[:, -1], sizes, parts)
        assert sorted(got) == plain_differencing(sizes, parts)


def test_mixing_keeps_the_bound_of_its_draws(spark, sf_dir):
    """Taken words differ from the target by draws alone: four standard deviations at most."""
    docs = table(spark, sf_dir, "documents")
    rows = op3_mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        rate = own[0].target / own[0].source_size
        part = rate - math.floor(rate)
        spread = math.sqrt(sum(r["size"] ** 2 for r in own) * part * (1 - part))
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * spread + 1e-6


def test_licenses(docs_of):
    docs = docs_of([
        (1, "x\nReleased under the MIT License.\ny under the\nmit license", "s"),
        (2, "This work is licensed under the GNU General Public License, version 2.", "s"),
        (3, "licensed under CC BY-NC 4.0 and Apache License, Version 2.0.", "s"),
        (4, "general public work under the version of this", "s"), (5, None, "s"),
        (6, "The license is under the MIT. Released by us.", "s")])
    got = {r.doc_id: r for r in op8_license_scans.license_digest(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 2, 7, "mit")
    assert (got[2].base_labels, got[2].labels) == ("", "gpl") and 0.8 <= got[2].score < 1
    assert got[3].base_labels == "apache-2,cc-by-nc" and "cc-by-nc" in got[3].labels
    assert (got[4].labels, got[4].score) == ("", 0.0)
    assert (got[5].n_words, got[5].n_base, got[5].first_word) == (0, 0, None)
    assert got[6].labels == "mit" and got[6].base_labels == ""


def brute_licenses(words, templates, containment):
    """Every window of every template, by its words."""
    best = {}
    for t in templates:
        own = set(op8_license_scans.tokens(t.text))
        reach = math.ceil(len(op8_license_scans.tokens(t.text)) / containment - 1e-9)
        for start in range(len(words)):
            held = own & set(words[start:start + reach])
            share = len(held) / len(own)
            if share >= containment - 1e-9 and set(t.must) <= held:
                best[t.label] = max(best.get(t.label, 0), share)
    return best


def test_license_join_against_brute_force(docs_of):
    random.seed(9)
    words = [f"t{i}" for i in range(14)]
    templates = []
    for k in range(7):
        said = random.choices(words, k=random.randint(3, 12))
        templates.append(op8_license_scans.Template(f"l{k % 5}", " ".join(said), tuple(random.sample(
            sorted(set(said)), random.randint(1, 2)))))
    texts = [random.choices(words + ["x"] * random.randint(0, 40), k=random.randint(0, 60)) for _ in range(250)]
    # Notices with words changed, dropped, doubled and put in between.
    for t in templates * 12:
        said = t.text.split()
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(said))
            said[at:at + 1] = random.choice([["x"], [], [said[at]] * 2, ["x", said[at]]]) or ["y"]
        texts.append(["y"] * random.randint(0, 30) + said + random.choices(words, k=random.randint(0, 3)))
    docs = docs_of([(i, " ".join(t), "s") for i, t in enumerate(texts)])
    for containment in (0.6, 0.8, 1.0):
        rows = op8_license_scans.scan_bases(docs, templates).withColumn("rid", F.col("doc_id"))
        hits = op8_license_scans.template_hits(rows, op8_license_scans.shapes(templates, containment))
        got = {(r.rid, r.label): r.containment for r in op8_license_scans.matches(
            hits, templates, containment).collect()}
        want = {(i, label): pytest.approx(share) for i, t in enumerate(texts)
                for label, share in brute_licenses(t, templates, containment).items()}
        assert got == want and len(want) > 20


MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to
the following conditions:"""
APACHE = """ Licensed under the Apache License, Version 2.0 (the "License");
 you may not use this file except in compliance with the License.
 You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize("text, labels", [
    ("Released under the Apache License, Version 2.0", "apache-2"), ("Released under the GPL license", ""),
    ("the license was released yesterday and everything under the sun", ""), (MPL, "mpl-2"), (BSD, "bsd"),
    (GPL, "gpl"), (MIT, "mit"), (APACHE, "apache-2"), ("prose " * 400 + BSD + " prose" * 400, "bsd"),
    (MIT + "\n\n" + MPL, "mit,mpl-2"), ("free of charge, to any person who asks for a copy of the software", "")])
def test_published_notices(docs_of, text, labels):
    [got] = op8_license_scans.license_digest(docs_of([(1, text, "s")])).collect()
    assert got.labels == labels and (got.score >= 0.8) == bool(labels)


def test_licenses_of_awkward_rows(awkward):
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    got = op8_license_scans.license_digest(awkward).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter((i, len(word.findall(text.translate(lower)))) for i, text in rows)
    assert Counter((r.doc_id, r.n_words) for r in got) == want
    assert {(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got} == {
        (0, None, None, "", "", 0.0)}


def hashed(*values):
    """Spark's xxhash64: each value hashed with the hash before as its seed."""
    seed = 42
    for value in values:
        raw = value.encode() if isinstance(value, str) else (value % 2**64).to_bytes(8, "little")
        if isinstance(value, Short):
            raw = (value % 2**32).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >> 63 else seed


class Short(int):
    """An int column's value, of four bytes."""


def brute_units(text):
    units, now = [], ""
    for c in text:
        now += c
        if c in "aeoAEO" or ord(c) <= 0x20 or ord(c) >= 0x80:
            units, now = units + [now], ""
    return units + [now] if now else units


def brute_anchors(text):
    units, found = brute_units(text), []
    for i in range(len(units) - 4):
        inner = [hashed(units[i + k], units[i + k + 1]) for k in range(4)]
        if min(inner[0], inner[3]) <= min(inner[1], inner[2]):
            found.append((i, hashed(inner[0], inner[2], units[i + 4])))
    return units, found


def brute_numbers(text):
    units, found = brute_anchors(text)
    if units and not found:
        found = [(0, hashed(*units))]
    links = {hashed(a, b, Short(y - x)) for (x, a), (y, b) in zip(found, found[1:])}
    return {a for _, a in found} | links


def anchors_of(spark, text):
    df = spark.createDataFrame([(text,)], "text string").withColumn("units", op4_fingerprints.units_of(F.col("text")))
    return op4_fingerprints.with_anchors(df, "units", "found").first()


def test_anchors_against_brute_force(spark):
    random.seed(4)
    texts = ["".join(random.choices("abcdeostnr  .\n-é漢🎉\x80AEO", k=random.choice([0, 3, 9, 40, 300]))) for _ in range(40)]
    texts += ["x" * 500, "a" * 50, "漢字" * 30]
    for text in texts:
        row = anchors_of(spark, text)
        units, found = brute_anchors(text)
        assert row.units == units and [tuple(f) for f in row.found] == found


def test_anchors_are_context_free(spark):
    random.seed(5)
    for letters in ("abcdefghijklmnop qrstuvw", "漢字仮名交文", "bcdfgh-"):
        passage = "".join(random.choices(letters, k=400)) + "a"
        alone = anchors_of(spark, passage)
        inside = anchors_of(spark, "Before it, a " + passage + "and after it")
        off = len(brute_units("Before it, a "))
        assert {(f.at + off, f.anchor) for f in alone.found} <= {(f.at, f.anchor) for f in inside.found}
        # Any 2 * K - S units in a row hold an anchor.
        places = [f.at for f in alone.found]
        assert not places or max(b - a for a, b in zip(places, places[1:])) <= 2 * op4_fingerprints.K


def test_fingerprints_against_brute_force(docs_of):
    random.seed(8)
    words = ["the", "of", "and", "stone", "ocean", "brrr", "x", "漢字", "é", "well-known", "a"]
    texts = [" ".join(random.choices(words, k=n)) for n in (300, 1, 40, 300, 7, 2, 3, 5, 6, 9, 0, 12, 60)]
    texts += [texts[0], "", None, "漢字" * 100, "y" * 90, "z" * 91, "ab" * 50, texts[2], texts[2] + "!"]
    docs = docs_of([(10 * i, t, "s") for i, t in enumerate(texts)])
    got = op4_fingerprints.fingerprint_digest(docs.repartition(3)).orderBy("doc_id").collect()
    whole, prints = [t or "" for t in texts], defaultdict(set)

    def near(a, b):
        x, y = brute_numbers(a), brute_numbers(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, r in enumerate(got):
        text, after = whole[i], whole[(i + 1) % len(whole)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == pytest.approx((near(text, edited), near(text, after)))
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert got[0].near_edited > 0.2 > got[0].near_next
    # Halves left as they were are seen in short texts too.
    short = [r for r, text in zip(got, whole) if 8 <= len(brute_units(text[:len(text) - len(text) // 2])) < 30]
    assert short and all(r.near_edited > 0 for r in short)


def brute_repeats(texts, window=35):
    seen = Counter()
    words = [(t or "").encode().split() for t in texts]
    for w in words:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept).hexdigest()


def test_repeats_against_brute_force(docs_of, monkeypatch):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[random.choice(vocabulary) for _ in range(random.randint(30, 80))] for _ in range(12)]
    texts = []
    for _ in range(300):
        text = []
        for _ in range(random.randint(0, 5)):
            text += random.choice(passages) if random.random() < 0.6 else [
                random.choice(vocabulary) for _ in range(random.randint(1, 90))]
        texts.append(" ".join(text))
    texts += ["a b " * 60, "a " * 200, texts[0], texts[0], None, " ".join(passages[0][:34])]
    docs = docs_of([(i, t, "s") for i, t in enumerate(texts)])
    for limit, spread in ((64, 2_000), (3, 2_000), (3, 2)):
        monkeypatch.setattr(op5_substrings, "LIMIT", limit)
        monkeypatch.setattr(op5_substrings, "SPREAD", spread)
        got = op5_substrings.substring_digest(docs).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == list(brute_repeats(texts))


def test_repeats_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = op5_substrings.substring_digest(docs).orderBy("doc_id").collect()
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r)[1:] for r in got] == list(brute_repeats(texts))
