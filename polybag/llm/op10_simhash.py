"""SimHash near duplicates, searched by pigeonring filtering.

Fingerprint: a bit is set if it is set in over half of the hashes of a text's word shingles.
Two fingerprints link at ``BITS = 3`` or fewer differing bits.  The 64 bits form a ring of four
segments.  If two fingerprints link, some segment starts a chain in which the first one, two,
three and four segments differ in no more than 3/4 of a bit each: in 0, 1, 2 and 3 bits.  So the
first segment is equal and the second differs in one bit at most, hence in one of its four
quarters at most: fingerprints that link share a key of a segment and three quarters of the next.
There are 16 such keys (four starts, four quarters left out).  Fingerprints that share a key are
checked along the chain, segment by segment, and in full at its end.

A key that many fingerprints share is cut into blocks that meet pairwise, a pair of blocks a
unit, so no task holds more than two blocks; a unit returns only a forest of its links.

A null text counts as empty; a text without words has fingerprint 0 and links like others; one
shorter than a shingle is hashed as a whole.  Repeated rows link with each other.  Null ids belong
to their component but never name it unless they are alone.  Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole, text_of, unwrapped
from polybag.llm.components import components
from polybag.session import map_arrow, saved

SHINGLE = 3
SEED = 42
BITS = 3
# Fingerprints of one key that one block holds, on average.
BLOCK = 512


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), seed) for run in runs), np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start:start + (1 << 15)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            marks = np.array([simhash(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks.view(np.int64))],
                ["doc_id", "text_key", "mark"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, mark) of every row; ``mark`` is the fingerprint as a bigint."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.md5(text_of()).alias("text_key"), text_of().alias("text"))
    return map_arrow(rows, _fingerprints(shingle), "doc_id bigint, text_key string, mark bigint")


def _segment(mark: Column, i: int) -> Column:
    return F.shiftrightunsigned(mark, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def ring_keys(mark: Column) -> Column:
    """The 16 keys of a fingerprint; the last four bits name start and quarter."""
    return F.array(*[
        F.shiftleft(_segment(mark, i), 20)
        .bitwiseOR(F.shiftleft(_segment(mark, i + 1).bitwiseAND(F.lit(0xFFFF & ~(0xF << 4 * q))), 4))
        .bitwiseOR(F.lit(4 * i + q)) for i in range(4) for q in range(4)])


def _links(marks: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which of the fingerprints in the last axis link, checked along the chain from ``start``."""
    apart = marks[..., :, None] ^ marks[..., None, :]
    turn = np.asarray(start, dtype=np.uint64)[..., None, None] * np.uint64(16)
    turned = (apart >> turn) | (apart << ((np.uint64(64) - turn) % np.uint64(64)))
    linked = (turned & np.uint64(0xFFFF)) == 0
    for segments in (2, 3, 4):
        inside = np.uint64((1 << 16 * segments) - 1)
        linked &= np.bitwise_count(turned & inside) <= segments * BITS // 4
    return linked


def _forest(marks: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the unit's links connect: each fingerprint to the first."""
    linked = _links(marks, start)
    label = np.arange(len(marks))
    while True:
        lower = np.where(linked, label[None, :], len(marks)).min(axis=1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    hung = np.flatnonzero(label != np.arange(len(marks)))
    return marks[hung], marks[label[hung]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit to edges.  Units of two are checked together, others one by one."""
    kept = [np.empty(0, dtype=np.int64) for _ in range(4)]

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        unit = np.stack(columns[:3])
        cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
        first = np.concatenate([[0], cuts]).astype(np.int64)
        sizes = np.diff(np.concatenate([first, [unit.shape[1]]]))
        marks, start = columns[3].view(np.uint64), (columns[0] & 15) // 4
        twos = first[sizes == 2]
        pairs = marks[twos[:, None] + np.arange(2)]
        good = _links(pairs, start[twos])[:, 0, 1]
        u, v = [pairs[good, 1]], [pairs[good, 0]]
        for at, size in zip(first[sizes > 2], sizes[sizes > 2]):
            a, b = _forest(np.unique(marks[at:at + size]), int(start[at]))
            u.append(a)
            v.append(b)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    for batch in batches:
        columns = [np.concatenate([k, c.to_numpy(zero_copy_only=False)])
                   for k, c in zip(kept, batch.columns)]
        if not len(columns[0]):
            continue
        unit = np.stack(columns[:3])
        last = np.flatnonzero((unit != unit[:, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0
        kept = [c[cut:] for c in columns]
        if cut:
            yield edges([c[:cut] for c in columns])
    if len(kept[0]):
        yield edges(kept)


def linked_pairs(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``mark`` rows to (u, v) edges with the components of all links."""
    keyed = saved(marks.select("mark", F.explode(ring_keys(F.col("mark"))).alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    cut = keyed.join(shared, "key").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.select("key", F.least("own", "other").cast("bigint").alias("a"),
                       F.greatest("own", "other").cast("bigint").alias("b"), "mark")
    dealt = units.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return map_arrow(dealt, _units, "u bigint, v bigint")


def rooted_marks(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mark, first, root) of each distinct fingerprint: its least ``doc_id``, and its component.

    Equal fingerprints are one node, however many documents share them.
    """
    nodes = saved(marked.groupBy("mark").agg(F.min("doc_id").alias("first")), "marks")
    roots = components(linked_pairs(nodes.select("mark"), block))
    return nodes.join(roots, nodes["mark"] == roots["node"], "left").select(
        "mark", "first", F.coalesce("root", "mark").alias("root"))


def with_components(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``component_id``, the least ``doc_id`` that links reach, to (doc_id, mark, ...) rows."""
    rooted = rooted_marks(marked, block)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("mark", "component_id"), "mark")


def simhash_digest(docs: DataFrame) -> DataFrame:
    marked = saved(fingerprints(docs), "simhash")
    return with_components(marked).select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One document of each component stays, the one of the least id, with its columns.

    A null id counts as larger than all others; documents of one id and different texts go by the
    MD5 of their text.  Of rows that repeat id and text one stays, by a hash of their other columns.
    Fingerprints and ids alone decide; whole rows move once, to meet the decision.
    """
    marked = saved(fingerprints(docs, shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    rooted = rooted_marks(marked, block).select("mark", "root")
    kept = marked.join(rooted, "mark").groupBy("root").agg(F.min(order).alias("first")).select(
        _slot(F.col("first.doc_id"), F.col("first.text_key")).alias("_slot"))
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = kept_whole(docs, _slot(F.col("doc_id"), F.md5(text_of())).alias("_slot"),
                      F.xxhash64(F.to_json(F.struct(*rest)) if rest else F.lit(0)).alias("_rest"))
    return unwrapped(rows.join(kept, "_slot").groupBy("_slot").agg(F.min_by(ROW, "_rest").alias(ROW)))


def _slot(doc_id: Column, text_key: Column) -> Column:
    """A document as one key that is never null."""
    return F.concat(text_key, F.lit(":"), F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")))
