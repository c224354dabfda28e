"""How far the sources of a language lie apart, and which terms set a source off from its language.

Spark ML's ``CountVectorizer`` (the largest integer as ``vocabSize``) turns each document into the
exact sparse vector of its terms.  Entries of the vectors are summed per (lang, source), as
``Summarizer`` sums vectors, but sparse, so that a buffer holds one number and not a vocabulary.
The model is fitted on the table of kept terms, those that ``min_docs`` documents of a language
hold: an aggregate finds them at a fraction of the cost of ``fit(minDF)`` over all documents, and
their number is then known.  All languages share one model; of the sums, those stay whose term the
language itself keeps, which is what a model for each language would give.

A term has, in a group, ``p = 1 + floor(SCALE * (count + 1) / (N + V))``.  The divergence of two
sources is the sum of ``floor((p - q)^2 / q)`` over all V terms of the language, but only terms
that a source holds are visited: terms neither holds add a constant, terms one holds follow from
how many of its terms have each count, and only terms that both hold are met one by one, in the
row that lists the sources of a term.  Tasks add these up per pair of sources before the shuffle.

``CountVectorizer`` keeps its vocabulary on the driver and broadcasts it.  Beyond ``VOCABULARY``
kept terms the sums come from the table that told which terms are kept: occurrences and documents
per (group, term), added up in the tasks and shuffled.  Either way the result is the same.

Counts are exact up to 2^53 (vectors hold doubles), shares use 38-digit integers.  Null text, lang
and source count as ''.  A text without terms still makes its group appear; a language whose terms
are all rare has V = 0, values 0 and no terms listed.  Repeated rows count as documents of their
own.  Ties in value are ranked by the bytes of the item.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.llm.common import ascii_lower, text_of
from polybag.operators.skew import BROADCAST_ROWS, sorted_rank
from polybag.session import map_arrow, saved, scratch_path

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
# Kept terms up to which a vocabulary may be held on the driver and broadcast: some 60 MB as text.
# With 0.7 million a driver of 1.5 GB was within 170 MB of its end.
VOCABULARY = 500_000
ALL_TERMS = 2**31 - 1
_BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
# The same on bytes: A-Z in lower case, a space for what stands between.
_FLAT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
# Partial sums a task holds before it emits them.
_HELD_PAIRS = 1_000_000


def terms_of(text: Column) -> Column:
    """Runs of anything but ASCII other than letters, A-Z in lower case.

    Cut at what stands between, a class of ASCII alone, which the search looks up in a table; the
    complement would be many times slower.  ``lower`` is exact and fast where all is ASCII.
    """
    ascii_alone = F.octet_length(text) == F.length(text)
    flat = F.when(ascii_alone, F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(flat, _BETWEEN), "")


def numbered_groups(docs: DataFrame) -> DataFrame:
    """(lang, source, at): every group that occurs, with its place in the order of their names."""
    names = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"))
    return saved(sorted_rank(names.distinct(), "lang", "source", rank="at"), "groups")


def tokenized(docs: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[str]]:
    """(keys, terms) of every document, and the keys that tell its group.

    A list of groups that is short (it is counted) is broadcast, and a number is the key; with a
    longer one the names are, so texts are never shuffled to meet it.
    """
    rows = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    keys = ["lang", "source"]
    if groups.count() <= BROADCAST_ROWS:
        rows, keys = rows.join(F.broadcast(groups), keys), ["at"]
    return rows.select(*keys, terms_of(F.col("text")).alias("terms")), keys


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, text) rows to (name, term, n, docs): occurrences and documents, added up per batch."""
    for batch in batches:
        n: dict[str, Counter] = defaultdict(Counter)
        docs: dict[str, Counter] = defaultdict(Counter)
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            terms = text.as_py().translate(_FLAT).split()
            n[group].update(terms)
            docs[group].update(set(terms))
        for group, counts in n.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                 pa.array(list(counts.values()), pa.int64()),
                 pa.array([docs[group][t] for t in counts], pa.int64())], ["name", "term", "n", "docs"])


def _name(lang: Column, source: Column) -> Column:
    """A group's names as one text that no other group has."""
    return F.to_json(F.array(lang, source))


def term_counts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, at, term, n, docs) of every term of every group, from one reading of the texts.

    Tasks add up batches of documents before the shuffle; groups get their numbers after it.
    """
    rows = docs.select(_name(text_of("lang"), text_of("source")).alias("name"), text_of().alias("text"))
    tallied = map_arrow(rows, _tallied, "name string, term string, n bigint, docs bigint")
    return tallied.groupBy("name", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(
        groups.select("lang", "at", _name(F.col("lang"), F.col("source")).alias("name")), "name").drop("name")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms that at least ``min_docs`` documents of the language hold."""
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).select("lang", "term")


def counts_by_vectors(tokens: DataFrame, keys: list[str], kept: DataFrame) -> DataFrame:
    """(keys, term, n) of every term kept in some language: sums of CountVectorizer's entries.

    ``kept`` must not be empty.
    """
    spark = tokens.sparkSession
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=ALL_TERMS).fit(
        kept.select(F.array("term").alias("terms")))
    path = scratch_path(spark, "vocabulary")
    model.write().save(path)
    vocabulary = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("place", "term"))
    vectors = model.transform(tokens).select(*keys, F.unwrap_udt("vector").alias("v"))
    sums = vectors.select(*keys, F.explode(F.arrays_zip(
        F.col("v.indices").alias("place"), F.col("v.values").alias("n"))).alias("e")).groupBy(
        *keys, F.col("e.place").alias("place")).agg(F.sum("e.n").cast("bigint").alias("n"))
    return sums.join(vocabulary, "place").select(*keys, "term", "n")


def term_rows(docs: DataFrame, groups: DataFrame, min_docs: int = MIN_DOCS,
              vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per kept term: (lang, term, n, held), ``held`` an array of (at, n)."""
    counts = saved(term_counts(docs, groups), "term-counts")
    kept = saved(kept_terms(counts, min_docs), "kept")
    if 0 < kept.count() <= vocabulary:
        tokens, keys = tokenized(docs, groups)
        counts = counts_by_vectors(tokens, keys, kept).join(groups, keys)
    # A term may be kept in one language and occur in another.
    return counts.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("at", "n")).alias("held")).join(kept, ["lang", "term"])


def share(n: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + size)) in whole numbers."""
    return F.expr(f"1 + (cast({n} + 1 AS DECIMAL(20, 0)) * {SCALE}) "
                  f"div (cast({total} AS DECIMAL(20, 0)) + {size})")


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) in whole numbers; both are at most SCALE + 1."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _both_held(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """What a pair's common terms add beyond the sums that take each side for itself.

    Rows with equally many sources form a matrix; one column after the other is held against all.
    """
    def of(p, q):
        return (p - q) ** 2 // q

    def emitted(held):
        keys = np.fromiter(held, np.int64, len(held))
        return pa.RecordBatch.from_pydict({
            "a": keys // groups, "b": keys % groups,
            "value": np.fromiter(held.values(), np.int64, len(held))})

    held: dict[int, int] = {}
    for batch in batches:
        offsets = batch.column("at").offsets.to_numpy()
        at, p, zero = (batch.column(c).values.to_numpy() for c in ("at", "p", "zero"))
        widths = np.diff(offsets)
        for width in np.unique(widths[widths > 1]):
            starts = offsets[:-1][widths == width]
            # Rows at a time, so that a wide row costs no more memory than many narrow ones.
            step = max(1, 1_000_000 // int(width))
            for first in range(0, len(starts), step):
                cells = starts[first:first + step, None] + np.arange(width)
                g, ps, zs = at[cells], p[cells], zero[cells]
                for i in range(width):
                    p0, z0 = ps[:, i, None], zs[:, i, None]
                    more = of(p0, ps) - of(p0, zs) - of(z0, ps) + of(z0, zs)
                    key = (g[:, i, None] * groups + g).ravel()
                    order = np.argsort(key, kind="stable")
                    ordered = key[order]
                    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    for k, v in zip(ordered[edge].tolist(),
                                    np.add.reduceat(more.ravel()[order], edge).tolist()):
                        held[k] = held.get(k, 0) + v
            if len(held) > _HELD_PAIRS:
                yield emitted(held)
                held = {}
    if held:
        yield emitted(held)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP,
               vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``."""
    named = numbered_groups(docs)
    rows = saved(term_rows(docs, named, min_docs, vocabulary), "term-rows")
    each = rows.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("h")).select(
        "term", "lang_n", "h.at", "h.n")

    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("lang_total"))
    totals = each.groupBy("at").agg(F.sum("n").alias("total"))
    groups = saved(named.join(totals, "at", "left").join(langs, "lang", "left")
                   .na.fill(0, ["total", "size", "lang_total"]).withColumn(
        "zero", F.when(F.col("size") > 0, share("0", "total", "size")).otherwise(1)), "groups")
    n_groups = groups.count()

    shares = saved(each.join(groups, "at").select(
        "lang", "source", "term", "at", "zero", "n", share("n", "total", "size").alias("p"),
        share("lang_n", "lang_total", "size").alias("q")), "shares")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return found.withColumn("rank", F.row_number().over(order))

    marked = ranked(shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        excess("p", "q").alias("value"))).where(F.col("rank") <= top)

    common = map_arrow(
        shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "zero")).alias("e"))
        .where(F.size("e") > 1).select("e.at", "e.p", "e.zero"),
        lambda batches: _both_held(batches, n_groups), "a bigint, b bigint, value bigint").where("a != b")

    # Terms of one side by their share: as many rows as a group has different counts.
    shapes = shares.groupBy("lang", "at", "zero", "p").agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("at").alias("other"), F.col("zero").alias("other_zero"))
    met = shapes.join(other, "lang").where("at != other")
    wide = "decimal(38,0)"

    def weighed(p: str, q: str, z: str, y: str) -> Column:
        return F.col("k").cast(wide) * (excess(p, q) - excess(z, y))

    one_sided = met.select(
        F.col("at").alias("a"), F.col("other").alias("b"),
        weighed("p", "other_zero", "zero", "other_zero").cast(wide).alias("value"),
    ).unionByName(met.select(
        F.col("other").alias("a"), F.col("at").alias("b"),
        weighed("other_zero", "p", "other_zero", "zero").cast(wide).alias("value")))
    neither = groups.join(other, "lang").where("at != other").select(
        F.col("at").alias("a"), F.col("other").alias("b"),
        (F.col("size").cast(wide) * excess("zero", "other_zero")).cast(wide).alias("value"))
    sums = neither.union(one_sided).union(
        common.select("a", "b", F.col("value").cast(wide))).groupBy("a", "b").agg(
        F.sum("value").cast("bigint").alias("value"))
    first = groups.select("lang", "source", F.col("at").alias("a"))
    second = groups.select(F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = ranked(sums.join(first, "a").join(second, "b").select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(marked)


def divergence_digest(docs: DataFrame) -> DataFrame:
    """The audit with its production parameters."""
    return divergence(docs).select(
        "lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")
