"""Document fingerprints from closed syncmers over short units of characters.

A unit ends after an ``a``, ``e`` or ``o``, white space, or any character beyond ASCII: some three
characters of prose, one of unspaced scripts.  Where units end depends on single characters, not on
words or on where a run began.  Each run of ``K`` units holds inner runs of ``S``.  The run is an
anchor if the least hash of its inner runs is that of the first or the last: that depends on the
run alone, so an unchanged passage keeps its anchors wherever it stands, every edit spoils only
the anchors that touch it, and ``2 * K - S`` unchanged units in a row hold one at least.

Anchors are matched by their positions: besides its hash, an anchor counts with the hash of the next
one and their distance in units, which an equal passage keeps at another place while a chance
meeting does not.  Two texts are alike by the share of all these numbers, of both texts together,
that are in both: none is left out, whatever the length.  The fingerprint as text names the
``NAMED`` least anchors, and all of them in one hash.

A text without anchors, as short ones may be, has the hash of all its units as its only one; a
null text counts as empty and has an empty fingerprint, and two empty ones are alike by 1.  In
order of ``doc_id``, nulls come first and equal ids go by the md5 of their text; of repeated rows
each is followed by its copy but the last.  A single document is followed by itself.  An empty
table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.llm.common import text_of
from polybag.operators.skew import sorted_rank

K, S = 5, 2
# A unit ends after one of these.
LAST = r"[aeoAEO\x00-\x20\x{80}-\x{10FFFF}]"
NAMED = 16
# Rows of a piece: short, so that the pieces that one task gets by their hash even out.
RUN = 100


def units_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"(?<={LAST})"), "")


def _anchored(starts: Column, inner, last: str) -> Column:
    """Of the runs that begin at ``starts``, the anchors as (at, anchor)."""
    def is_anchor(i: Column) -> Column:
        between = F.least(*[inner(i, k) for k in range(1, K - S)])
        return F.least(inner(i, 0), inner(i, K - S)) <= between

    return F.transform(F.filter(starts, is_anchor), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[inner(i, k) for k in range(0, K - S + 1, S)], F.get(last, i + K - 1)).alias("anchor")))


def _from_to(first: Column, last: Column) -> Column:
    """The numbers from ``first`` to ``last``, none if that is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def with_anchors(docs: DataFrame, units: str, out: str) -> DataFrame:
    """Add ``out``: (at, anchor) structs in order, ``at`` the first unit of the run."""
    # Each step is a column of its own, so that what it builds is built once.
    rows = docs.withColumn("_inner", F.transform(
        units, lambda w, i: F.xxhash64(w, *[F.get(units, i + k) for k in range(1, S)])))
    return rows.withColumn(out, _anchored(
        _from_to(F.lit(0), F.size(units) - K), lambda i, k: F.get("_inner", i + k), units)).drop("_inner")


def with_edited_anchors(rows: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the anchors of the edited text, without looking at most of it.

    ``rows`` has the edited text's ``units``, the anchors ``found`` of the text and ``next_found`` of the
    next one, the numbers of units that are ``whole`` in the part kept and ``next_whole`` in the part put
    after it, and ``merged``, 1 if a unit goes across the seam, else 0.  Anchors inside a part are the
    text's own; runs across the seam and at the end are looked at.
    """
    whole, after = F.col("whole"), F.col("whole") + F.col("next_whole")
    end = F.size("units") - K
    seam = whole + F.col("merged")

    def inner(i: Column, k: int) -> Column:
        return F.xxhash64(*[F.get("units", i + k + j) for j in range(S)])

    across = _from_to(F.greatest(F.lit(0), whole - K + 1), F.least(seam - 1, end))
    ending = _from_to(F.greatest(seam, after - K + 1), end)
    moved = F.transform(F.filter("next_found", lambda f: (f.at >= F.col("merged")) & (
        f.at + K <= F.col("next_whole"))), lambda f: F.struct((f.at + whole).alias("at"), f.anchor.alias("anchor")))
    return rows.withColumn(out, F.concat(
        F.filter("found", lambda f: f.at + K <= whole), _anchored(across, inner, "units"), moved,
        _anchored(ending, inner, "units")))


def with_numbers(rows: DataFrame, found: str, units: str, out: str) -> DataFrame:
    """Add ``out``: the distinct numbers that a text is compared by; see above."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(units).alias("anchor")))
    kept = F.when((F.size(found) > 0) | (F.size(units) == 0), F.col(found)).otherwise(whole)
    rows = rows.withColumn("_kept", kept)
    links = F.transform(F.slice("_kept", 2, F.greatest(F.size("_kept") - 1, F.lit(0))), lambda f, i: F.xxhash64(
        F.get("_kept", i).anchor, f.anchor, f.at - F.get("_kept", i).at))
    return rows.withColumn(out, F.array_distinct(F.concat("_kept.anchor", links))).withColumn(
        f"{out}_text", _as_text(F.col("_kept.anchor"))).drop("_kept")


def _as_text(anchors: Column) -> Column:
    """The least anchors, and a hash of all in order."""
    def hexed(number: Column) -> Column:
        return F.lower(F.lpad(F.hex(number), 16, "0"))

    least = F.slice(F.sort_array(F.array_distinct(anchors)), 1, NAMED)
    return F.when(F.size(anchors) == 0, "").otherwise(F.concat(
        F.array_join(F.transform(least, hexed), ""), hexed(F.xxhash64(anchors))))


def likeness(a: str, b: str) -> Column:
    """Of two texts' numbers, from 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def by_piece(docs: DataFrame) -> DataFrame:
    """(piece, place, guest, doc_id, text): rows in order, cut into pieces of ``RUN`` rows.

    Ids are ranked without their texts.  The first row of a piece is also a guest at the end of
    the piece before it, and the first row of all at the end of the last piece, so every row has
    its successor in its piece.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.md5("text"))
    ranks = sorted_rank(rows.select("doc_id", "key").distinct(), "doc_id", "key",
                        rank="place", total="total")
    placed = rows.withColumnsRenamed({"doc_id": "_id", "key": "_key"}).join(
        ranks, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key")))
    own = F.floor(F.col("place") / RUN)
    last = F.floor((F.col("total") - 1) / RUN)
    before = F.when(F.col("place") == 0, last).otherwise(own - 1)
    stays = F.struct(own.alias("piece"), F.lit(False).alias("guest"))
    visits = F.struct(before.alias("piece"), F.lit(True).alias("guest"))
    return placed.select("doc_id", "text", "place", F.inline(F.when(
        F.col("place") % RUN == 0, F.array(stays, visits)).otherwise(F.array(stays))))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found, numbers, numbers_text) and, of the next document, next_text, _found, _numbers."""
    order = Window.partitionBy("piece").orderBy("guest", "place")
    rows = by_piece(docs).withColumn("next_text", F.lead("text").over(order))
    rows = with_anchors(rows.withColumn("units", units_of(F.col("text"))), "units", "found")
    rows = with_numbers(rows, "found", "units", "numbers").drop("units")
    for name in ("found", "numbers"):
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(order))
    return rows.where(~F.col("guest"))


def with_edited(rows: DataFrame) -> DataFrame:
    """Add the edited text and the numbers of its units, of rows of ``with_next``."""
    rows = rows.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("head", F.left("text", F.col("n_chars") - half)).withColumn(
        "tail", F.left("next_text", half))

    def open_end(part: str, whole: Column) -> Column:
        """Whether the last unit of a part goes on in the text it was taken from."""
        return (F.col(part) != "") & ~whole & ~F.rlike(F.right(part, F.lit(1)), F.lit(rf"\A{LAST}\z"))

    rows = rows.withColumn("_open", open_end("head", F.lit(False))).withColumn(
        "_next_open", open_end("tail", F.length("tail") == F.length("next_text")))
    merged = F.col("_open") & (F.col("tail") != "")
    return rows.withColumn("edited", F.concat("head", "tail")).withColumn("units", units_of(F.col("edited"))).withColumn(
        "whole", F.size(units_of(F.col("head"))) - F.col("_open").cast("int")).withColumn(
        "next_whole", F.size(units_of(F.col("tail"))) - F.col("_next_open").cast("int")).withColumn(
        "merged", merged.cast("int")).drop("_open", "_next_open", "head", "tail", "text", "next_text")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    rows = with_edited_anchors(with_edited(with_next(docs)), "edited_found").drop("found", "next_found")
    rows = with_numbers(rows, "edited_found", "units", "edited_numbers")
    return rows.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("numbers_text").alias("fingerprint"), F.col("edited_numbers_text").alias("edited_fingerprint"),
        likeness("numbers", "edited_numbers").alias("near_edited"),
        likeness("numbers", "next_numbers").alias("near_next"))
