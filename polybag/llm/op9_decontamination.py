"""Find benchmark items in training documents: BM25 with block-max WAND, then a check of both parts.

The test items are the index, the documents' passages the queries.  A passage is a window of words
twice as long as the longest item, at a stride of half a window, so any occurrence of an item lies
in one passage.  An item is retrieved if its BM25 score reaches ``RETRIEVE`` of the score it gives
itself; with every weight divided by that threshold, the bar is 1 for all items.  Items stand in
blocks, each term keeps its largest weight per block, and a passage skips every block whose
largest weights don't add up to 1.  In the blocks left, WAND moves posting cursors from pivot to
pivot.  A retrieved item counts if the passage holds ``OVERLAP`` of the three-word runs of its
question (its leading two thirds) and of its answer (the rest) each.  An item of fewer than
``SHORT`` words has no parts worth the name: its words must stand in the passage in a row, and one
of fewer than ``RUN`` words counts only where it is a whole text.

Words are lower-cased, punctuation separates.  Spark weighs the terms over all items, deals the
items to shards of bounded size (``SHARD_ITEMS`` items, ``SHARD_BYTES`` bytes of text, or one item
that is longer) and writes an index per shard to the shared folder, each made in a task.  A task
on documents reads one shard after the other and holds one at a time besides the last one read.
Only the numbers of the shards, and two numbers about all items, pass through the driver; items
are never left out.

A null text or item counts as empty; empty texts hold nothing, items without words match nothing.
Repeated rows of documents are judged alike, repeated items are found each.  Empty tables give no
matches.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import accumulate, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole, text_of, unwrapped
from polybag.operators.skew import sorted_rank
from polybag.session import map_arrow, saved, scratch_path, ship_package
from polybag.sources import folders
from polybag.sources.samples import open_store

K1, B = 1.2, 0.75
RETRIEVE = 0.6
OVERLAP = 0.5
RUN = 3
SHORT = 6
BLOCKS = 32
SHARD_ITEMS = 5_000
SHARD_BYTES = 4_000_000
# Passages whose bounds are computed at once.
CHUNK = 512
_CUT = bytes.maketrans(
    bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))
_LEAKS = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().translate(_CUT).split()


def _runs(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < RUN:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(RUN))))


class Index(NamedTuple):
    """``bounds[term, block]`` and ``postings[term]``: (item, weight) by item; term 0 is unknown."""

    ids: list[int]
    parts: list[tuple]
    terms: dict[bytes, int]
    bounds: np.ndarray
    postings: list[list[tuple[int, float]]]
    block: int
    width: int


def term_weights(words: list[bytes], held: Mapping[bytes, int], items: int, mean: float) -> dict[bytes, float]:
    """BM25 weights of an item's terms, from the number of items that hold each."""
    return {t: math.log(1 + (items - held[t] + 0.5) / (held[t] + 0.5)) * n * (K1 + 1)
            / (n + K1 * (1 - B + B * len(words) / mean)) for t, n in Counter(words).items()}


def _checked(words: list[bytes]) -> tuple:
    """What a passage is held against: runs of question and answer, or the words of a short item."""
    if len(words) < SHORT:
        return (tuple(words),)
    cut = len(words) - max(1, len(words) // 3)
    return _runs(words[:cut]), _runs(words[cut:])


def build_index(items: list[tuple[int | None, list[bytes], dict[bytes, float]]]) -> Index:
    """Items as (id, words, weights)."""
    items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    block = max(4, math.ceil(len(items) / BLOCKS))
    terms = {t: k + 1 for k, t in enumerate(sorted({t for _, _, weights in items for t in weights}))}
    postings: list[list[tuple[int, float]]] = [[] for _ in range(len(terms) + 1)]
    bounds = np.zeros((len(terms) + 1, math.ceil(len(items) / block)), dtype=np.float32)
    for item, (_, _, weights) in enumerate(items):
        bar = RETRIEVE * sum(weights.values())
        for t, w in weights.items():
            postings[terms[t]].append((item, w / bar))
            k = terms[t], item // block
            bounds[k] = max(bounds[k], w / bar)
    return Index([i for i, _, _ in items], [_checked(words) for _, words, _ in items], terms, bounds, postings,
                 block, 2 * max(len(words) for _, words, _ in items))


def wand(index: Index, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
    """Items of ``blocks`` whose weights over the distinct ``terms`` reach 1."""
    found = []
    for b in blocks:
        first, end = b * index.block, (b + 1) * index.block
        cursors = []
        for t in terms[index.bounds[terms, b] > 0]:
            own = [p for p in index.postings[t] if first <= p[0] < end]
            cursors.append([0, own, float(index.bounds[t, b])])
        while True:
            cursors = [c for c in cursors if c[0] < len(c[1])]
            cursors.sort(key=lambda c: c[1][c[0]][0])
            pivot = next((k for k, total in enumerate(accumulate(c[2] for c in cursors))
                          if total >= 1 - 1e-5), None)
            if pivot is None:
                break
            item = cursors[pivot][1][cursors[pivot][0]][0]
            if cursors[0][1][cursors[0][0]][0] == item:
                score = 0.0
                for c in cursors:
                    if c[1][c[0]][0] != item:
                        break
                    score += c[1][c[0]][1]
                    c[0] += 1
                if score >= 1 - 1e-9:
                    found.append((item, score))
            else:
                for c in cursors[:pivot]:
                    while c[0] < len(c[1]) and c[1][c[0]][0] < item:
                        c[0] += 1
    return found


def _overlaps(parts: tuple, runs: set, words: list[bytes], lo: int, hi: int) -> tuple[float, float]:
    """Shares of an item's question and answer that the passage ``words[lo:hi]`` holds."""
    if len(parts) == 2:
        return tuple(len(p & runs) / len(p) for p in parts)
    whole, = parts
    if len(whole) < RUN:
        found = tuple(words) == whole
    else:
        found = any(tuple(words[i:i + len(whole)]) == whole for i in range(lo, hi - len(whole) + 1))
    return float(found), float(found)


def find_leaks(index: Index, text: str) -> list[dict]:
    """The items that a text holds, each with its best passage."""
    words = tokens(text)
    ids = np.fromiter(map(index.terms.get, words, repeat(0)), np.int64, len(words))
    half, size = index.width // 2, len(index.bounds)
    passages = max(1, -(-(len(words) - half) // half))
    best: dict[int, dict] = {}
    for first in range(0, passages, CHUNK):
        end = min(first + CHUNK, passages)
        # Passage k is the cells k and k + 1 of half a window each; its distinct known terms.
        known = np.flatnonzero(ids[first * half:(end + 1) * half]) + first * half
        cell, term = known // half, ids[known]
        pairs = np.unique(np.concatenate([
            (cell * size + term)[cell < end], ((cell - 1) * size + term)[cell > first]]))
        passage, term = pairs // size, pairs % size
        cuts = np.flatnonzero(np.diff(passage, prepend=-1))
        bound = np.add.reduceat(index.bounds[term], cuts, axis=0) if len(cuts) else np.empty((0, 1))
        for at in np.flatnonzero((bound >= 1 - 1e-4).any(axis=1)):
            k = passage[cuts[at]]
            lo, hi = k * half, min(k * half + index.width, len(words))
            terms = term[cuts[at]:cuts[at + 1] if at + 1 < len(cuts) else None]
            blocks = np.flatnonzero(bound[at] >= 1 - 1e-4)
            retrieved = wand(index, terms, blocks)
            if not retrieved:
                continue
            runs = set(_runs(words[lo:hi]))
            runs |= {tuple(words[i:i + n]) for n in range(1, RUN) for i in range(lo, hi - n + 1)}
            for item, score in retrieved:
                question, answer = _overlaps(index.parts[item], runs, words, lo, hi)
                if question >= OVERLAP and answer >= OVERLAP and (
                        item not in best or best[item]["score"] < score * RETRIEVE):
                    best[item] = {"item_id": index.ids[item], "score": score * RETRIEVE,
                                  "question": question, "answer": answer}
    return [best[i] for i in sorted(best)]


_WORDS = "item_id bigint, words array<binary>"


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [tokens(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.list_(pa.binary()))], ["item_id", "words"])


def _weighed(items: int, mean: float):
    """Rows sorted by shard to one pickled index per shard."""
    def built(shard: tuple, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{shard[0]}-{shard[1]}"]), pa.array([pickle.dumps(build_index(rows))])],
            ["shard", "index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["piece"], row["part"]
                if shard != now and rows:
                    yield built(now, rows)
                    rows = []
                now = shard
                counts = {e["term"]: e["items"] for e in row["held"]}
                rows.append((row["item_id"], row["words"], term_weights(row["words"], counts, items, mean)))
        if rows:
            yield built(now, rows)

    return run


def write_index(items: DataFrame, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES) -> str:
    """The index in shards of bounded size, each built in a task; the folder it lies in."""
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text"))
    said = map_arrow(texts, _said, _WORDS).where(F.size("words") > 0)
    sized = said.withColumn("key", F.xxhash64("item_id", "words")).withColumn(
        "copy", F.row_number().over(Window.partitionBy("key", "item_id", "words").orderBy("key")))
    placed = sorted_rank(sized, "key", "item_id", "words", "copy", rank="at").withColumn(
        "piece", F.floor(F.col("at") / shard_items))
    # Bytes before an item in its piece, which has ``shard_items`` items at most.
    before = Window.partitionBy("piece").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    length = F.aggregate("words", F.lit(0).cast("bigint"), lambda total, w: total + F.octet_length(w) + 1)
    dealt = saved(placed.withColumn("part", F.floor(F.coalesce(
        F.sum(length).over(before), F.lit(0)) / shard_bytes)).select("piece", "part", "at", "item_id", "words"), "items")
    facts = dealt.agg(F.count(F.lit(1)).alias("items"), F.avg(F.size("words")).alias("mean")).first()
    # How many items hold a term, next to each item: both ways by the term.
    terms = dealt.select("at", F.explode(F.array_distinct("words")).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    held = terms.join(counts, "term").groupBy("at").agg(F.collect_list(F.struct("term", "items")).alias("held"))
    whole = dealt.join(held, "at").select("piece", "part", "at", "item_id", "words", "held")
    path = scratch_path(spark, "index")
    map_arrow(whole.repartition("piece", "part").sortWithinPartitions("piece", "part", "at"),
              _weighed(facts["items"], facts["mean"]),
              "shard string, index binary").write.partitionBy("shard").parquet(path)
    return path


@lru_cache(maxsize=2)
def _shard(folder: str) -> Index:
    """The index in a folder; a worker keeps the one in use and the one before."""
    import pyarrow.parquet as pq

    store, base = open_store(folder)
    return pickle.loads(pq.read_table(base, filesystem=store, columns=["index"]).column(0)[0].as_py())


def _leaks(shards: list[str]) -> Column:
    """The items that a text holds, shard after shard."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for folder in shards:
                index = _shard(folder)
                for leaks, text in zip(found, batch):
                    leaks += find_leaks(index, text)
            yield pd.Series(found, dtype=object)
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, _LEAKS)(text_of())


def with_leaks(docs: DataFrame, items: DataFrame, **limits: int) -> DataFrame:
    """Every row as a struct, with ``leaks``: the items it holds."""
    spark = docs.sparkSession
    ship_package(spark)
    path = write_index(items, **limits)
    shards = [e.path for e in folders.entries(spark, path) if e.is_folder and e.name.startswith("shard=")]
    none = F.array().cast(_LEAKS)
    return kept_whole(docs, (_leaks(shards) if shards else none).alias("leaks"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return unwrapped(with_leaks(docs, items).where(F.size("leaks") == 0))


def leak_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item it holds."""
    return with_leaks(docs.select("doc_id", "text"), items).select(
        f"{ROW}.doc_id", F.inline("leaks")).withColumnsRenamed(
        {"question": "question_overlap", "answer": "answer_overlap"})
