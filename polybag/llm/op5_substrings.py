"""Remove word passages that occur more than once, by matching statistics on suffix automata.

A window is ``WINDOW = 35`` consecutive words.  A word goes if a window that covers it has the same
words as a window that starts anywhere else, in the same document or another.

An automaton of the whole corpus can't be built or broadcast, and one per shard that every document
is matched against costs shards times documents.  So windows choose their shard by content: a
window belongs to the least hash among its runs of ``ANCHOR`` words, equal windows to the same one,
and neighbouring windows mostly to the same place; they form a segment.  Only narrow segment rows
are shuffled.  A segment that occurs twice as a whole is settled by counting.  A shard whose hash
occurs in one segment only has nothing to match.  The words of the segments left, the seams of
repeated passages, are sent to their shard, whose task builds a suffix automaton of them and walks
each through it: where the longest match also ends in another segment at ``WINDOW`` words or
more, the window is repeated.  Shards of more than ``LIMIT`` segments are settled by counting each
window by its hash, which is as exact and combines before the shuffle.

Words are compared by 64-bit hashes, segments by two of them.  Equal texts are processed once and
count as often as they occur.  Their table is bucketed, so later joins don't move texts again.

A null text has no words; texts of fewer than 35 words keep all; repeated rows are documents that
repeat each other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.llm.common import text_of
from polybag.operators.skew import spread_join
from polybag.session import map_arrow, saved, scratch_path

WINDOW = 35
ANCHOR = 6
LIMIT = 64
# Rows of one segment or window that one task joins, on average.
SPREAD = 2_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
# A place in a stretch of hashes takes the low bits beside the hash.
_PLACE_BITS = 22
_PLACE_MASK = np.uint64((1 << _PLACE_BITS) - 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)


class Segments(NamedTuple):
    """Runs of windows: first window, number of windows, hash of the anchor, hash of the words."""

    at: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    body: np.ndarray


# Powers of the factor and of its inverse modulo 2**64, as far as they were needed.
_tables = {f: np.ones(1, dtype=np.uint64) for f in (_FACTOR, _INVERSE)}


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    if len(_tables[factor]) < n:
        _tables[factor] = np.cumprod(
            np.concatenate([[np.uint64(1)], np.full(2 * n, factor, dtype=np.uint64)]), dtype=np.uint64)
    return _tables[factor][:n]


def _slices(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair: a running polynomial, brought back to power 0."""
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * _powers(_FACTOR, len(values)), dtype=np.uint64, out=total[1:])
    body = (total[end] - total[start]) * _powers(_INVERSE, len(values) + 1)[start]
    return _mixed(body + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, from the bytes of the whole text at once."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _slices(_BYTES[raw], edges[::2], edges[1::2])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by doubling."""
    out, have = _mixed(h), 1
    while have < length:
        more = min(have, length - have)
        out = _mixed(out[:len(out) - more] * _FACTOR + out[more:])
        have += more
    return out


def _least(runs: np.ndarray, span: int) -> np.ndarray:
    """Place of the first least hash in each ``span`` of hashes, by doubling."""
    places = np.empty(len(runs) - span + 1, dtype=np.int64)
    step = 1 << _PLACE_BITS - 1
    for start in range(0, len(places), step):
        part = runs[start:start + step + span - 1]
        low = (part & ~_PLACE_MASK) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < span:
            more = min(have, span - have)
            low = np.minimum(low[:-more], low[more:])
            have += more
        places[start:start + len(low)] = (low & _PLACE_MASK).astype(np.int64) + start
    return places


def segments(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> Segments:
    runs = run_hashes(h, anchor)
    places = _least(runs, window - anchor + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    n = np.diff(np.concatenate([first, [len(places)]]))
    return Segments(first, n, runs[places[first]], _slices(_mixed(h), first, first + n + window - 1))


class Automaton:
    """Suffix automaton of several sequences; a state knows whether two of them end in it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.owner = [-1], [0], [-1]

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, own = self.next, self.link, self.len, self.owner
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                if own[q] != owner:
                    own[q] = -2 if own[q] != -1 else owner
                continue
            clone_only = q is not None
            if clone_only:
                p, cur = last, -1
            else:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                own.append(owner)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    if not clone_only:
                        link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    own.append(-1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = clone
                    if clone_only:
                        cur = clone
                        own[clone] = owner
                    else:
                        link[cur] = clone
            last = cur

    def settle(self) -> None:
        """Tell each state of the owners of all states that end in it: one, or -2 for several."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        own, link = self.owner, self.link
        for s in order:
            up = link[s]
            if own[up] == -1:
                own[up] = own[s]
            elif own[up] != own[s]:
                own[up] = -2

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of an added sequence that another one has too."""
        found, state, nxt, link, length, own = [], 0, self.next, self.link, self.len, self.owner
        for i, c in enumerate(sequence):
            state = nxt[state][c]
            if i + 1 < window:
                continue
            while length[link[state]] >= window:
                state = link[state]
            if own[state] == -2:
                found.append(i + 1 - window)
        return found


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tid", "copies", "at", "n", "anchor", "body"]
    for batch in batches:
        tids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts: list[tuple] = []
        for k, text in enumerate(batch.column(2).cast(pa.binary())):
            h = word_hashes(text.as_py())
            if len(h) >= WINDOW:
                s = segments(h)
                parts.append((np.full(len(s.at), tids[k]), np.full(len(s.at), copies[k]), *s))
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c) for c in columns[:2]), *(pa.array(c.astype(np.int32)) for c in columns[2:4]),
                *(pa.array(c.view(np.int64)) for c in columns[4:])], names)


def _sent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments, or for large shards a hash per window, beside its anchor."""
    for batch in batches:
        rows: list[tuple] = []
        tids = batch.column(0).to_numpy()
        for k, (text, wanted) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2))):
            h = word_hashes(text.as_py())
            whole = run_hashes(h, WINDOW)
            for w in wanted.as_py():
                if w["large"]:
                    anchor = w["anchor"].to_bytes(8, "big", signed=True)
                    rows += [(int(x), tids[k], w["at"] + i, w["single"], True, anchor) for i, x in
                             enumerate(whole[w["at"]:w["at"] + w["n"]].view(np.int64))]
                else:
                    part = h[w["at"]:w["at"] + w["n"] + WINDOW - 1]
                    rows.append((w["anchor"], tids[k], w["at"], w["single"], False, part.tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, kinds)],
            ["shard", "tid", "at", "single", "large", "words"])


def match_shard(members: list[tuple[int, int, bool, list[int]]]) -> list[tuple[int, int]]:
    """(tid, window) of repeated windows among (tid, at, single, words); others are reference."""
    automaton = Automaton()
    for owner, (_, _, _, words) in enumerate(members):
        automaton.add(words, owner)
    automaton.settle()
    return [(tid, at + i) for tid, at, single, words in members if single
            for i in automaton.repeated(words, WINDOW)]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard to (tid, at, n) of repeated windows."""
    def found(members: list[tuple]) -> list[tuple[int, int, int]]:
        return [(tid, at, 1) for tid, at in match_shard(members)] if len(members) > 1 else []

    shard, members = None, []
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for s, tid, at, single, words in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard:
                out += found(members)
                shard, members = s, []
            members.append((tid, at, single, np.frombuffer(words, dtype=np.uint64).tolist()))
        yield _spans(out)
    yield _spans(found(members))


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))],
        ["tid", "at", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, copies, text, spans in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                batch.column(2).cast(pa.binary()), batch.column(3)):
            words = text.as_py().split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            if copies > 1 and len(words) >= WINDOW:
                edge[0] = 1
            elif spans.is_valid:
                at = spans.values.field(0).to_numpy().astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + spans.values.field(1).to_numpy() + WINDOW - 1, -1)
            goes = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, gone in zip(words, goes.tolist()) if not gone])
            rows.append((key, len(words), int(goes.sum()), kept.decode()))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(
                columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["key", "n_words", "n_removed", "kept"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies, tid), bucketed by ``key`` in the shared folder.

    The table's name is dropped at once; the files stay, like all that is written there.
    """
    spark = docs.sparkSession
    texts = docs.select(F.md5("text").alias("key"), "text").groupBy("key").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    path = scratch_path(spark, "texts")
    name = "polybag_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.withColumn("tid", F.monotonically_increasing_id()).write.bucketBy(buckets, "key").option(
        "path", path).option("compression", "zstd").saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return written


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(tid, at, n): runs of windows of texts without copies that occur elsewhere."""
    found = saved(map_arrow(texts.select("tid", "copies", "text"), _segment_rows,
                            "tid bigint, copies bigint, at int, n int, anchor bigint, body bigint"),
                  "segments")
    kinds = saved(found.groupBy("anchor", "body").agg(
        F.sum("copies").alias("seen"), F.min(F.struct("tid", "at", "n")).alias("place")), "kinds")
    # Near copies share whole segments: a segment of many texts is salted over several tasks.
    kind = F.struct("anchor", "body").alias("kind")
    whole = spread_join(
        found.where("copies = 1").select(kind, "tid", "at", "n"),
        kinds.where("seen > 1").select(kind), "kind", "tid", heavy_rows=SPREAD).select("tid", "at", "n")
    shards = kinds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("seen").alias("least")).where("kinds > 1 and least = 1")
    wanted = kinds.join(shards, "anchor").select(
        "place.*", "anchor", (F.col("seen") == 1).alias("single"), (F.col("kinds") > LIMIT).alias("large"))
    # As many as a text has segments.
    per_text = wanted.groupBy("tid").agg(
        F.collect_list(F.struct("at", "n", "anchor", "single", "large")).alias("wanted"))
    keyed = per_text.join(texts.select("tid", "key"), "tid").select("key", "wanted")
    sent = saved(map_arrow(
        texts.join(keyed, "key").select("tid", "text", "wanted"), _sent_words,
        "shard bigint, tid bigint, at int, single boolean, large boolean, words binary"), "sent")
    dealt = sent.where("not large").select("shard", "tid", "at", "single", "words").repartition(
        "shard").sortWithinPartitions("shard")
    matched = map_arrow(dealt, _matched, "tid bigint, at int, n int")
    windows = sent.where("large").select(
        F.struct("shard", "words").alias("window"), "tid", "at", "single")
    often = windows.groupBy("window").agg(
        F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("seen")).where("seen > 1").select("window")
    counted = spread_join(windows.where("single"), often, "window", "tid", heavy_rows=SPREAD).select(
        "tid", "at", F.lit(1).alias("n"))
    return whole.unionByName(matched).unionByName(counted)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(key, n_words, n_removed, kept) of each distinct text; ``key`` is its md5."""
    rows = docs.select(text_of().alias("text"))
    texts = distinct_texts(rows)
    spans = repeated_windows(texts).groupBy("tid").agg(
        F.collect_list(F.struct("at", "n")).alias("spans"))
    keyed = spans.join(texts.select("tid", "key"), "tid").select("key", "spans")
    cut = texts.join(keyed, "key", "left").select("key", "copies", "text", "spans")
    return map_arrow(cut, _cut, "key string, n_words bigint, n_removed bigint, kept string")


def substring_digest(docs: DataFrame) -> DataFrame:
    cut = remove_repeats(docs).select(
        "key", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    rows = docs.select("doc_id", F.md5(text_of()).alias("key"))
    return rows.join(cut, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
