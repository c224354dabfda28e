"""Find licence notices: an exact set-similarity join of text blocks with licence templates.

A block is a window of consecutive words of a text, wherever its lines end, long enough for the
template and for as many foreign words as the threshold forgives: ``words / CONTAINMENT``.  It
matches a template if it holds at least ``CONTAINMENT`` of the template's distinct words and among
them all that tell it from other licences (``Template.must``).  Every window is meant, and every
template with a window that matches is found:

* Words of templates are ordered by how many places of the corpus hold them, rarest first.  A
  window that misses few enough words must hold one of the first ``size - need + 1`` in this
  order, so only places of these *prefix* words are candidates.
* A candidate meets the hits (places of template words) around it, by an equi-join on the text and
  cells of the window's length.  The *length* filter asks for ``need`` hits in reach, the *position*
  filter for room: the words before the candidate's in the order are those it can lack.
* What is left is verified window by window.

Texts that lack every template's telling words can't match and are not cut into words' places.

Base phrases are found where their words stand consecutively, across line ends too.

A null text counts as empty; an empty one has no words, labels or places and scores 0.  Repeated
rows are judged alike, a null id is an id; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polybag.llm.common import UPPER, text_of
from polybag.session import saved

# ASCII that no word holds: all but digits and letters.
_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
# The phrases of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2",
           "cc by nc": "cc-by-nc"}
CONTAINMENT = 0.8


class Template(NamedTuple):
    """A public notice, and the words without which a text like it is another licence's."""

    label: str
    text: str
    must: tuple[str, ...]


TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
             "subject to the following conditions", ("sublicense", "merge")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
             "except in compliance with the License. You may obtain a copy of the License at", ("apache", "2")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
             "License", ("creative", "commons", "noncommercial")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.",
             ("gnu", "general", "public")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
             "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version.", ("gnu", "general", "public")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
             ("mozilla", "public")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met:", ("redistribution", "binary")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
             "all copies.", ("fee", "appear")),
)


def spaced(text: Column) -> Column:
    """A-Z in lower case, and a space for all ASCII that is no letter or digit."""
    return F.translate(text, UPPER + _BETWEEN, UPPER.lower() + " " * len(_BETWEEN))


def tokens(text: str) -> list[str]:
    """The words of a template, which is plain ASCII."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


class _Shape(NamedTuple):
    """A template as the join needs it."""

    number: int
    words: list[str]
    must: list[str]
    need: int
    reach: int


def shapes(templates: Sequence[Template], containment: float) -> list[_Shape]:
    found = []
    for number, template in enumerate(templates):
        said = tokens(template.text)
        words = sorted(set(said))
        if not set(template.must) <= set(words):
            raise ValueError(f"{template.label}: a telling word is not in the text")
        found.append(_Shape(number, words, list(template.must), math.ceil(containment * len(words) - 1e-9),
                            math.ceil(len(said) / containment - 1e-9)))
    return found


def _places(words: Column, line: Column, phrase: str) -> Column:
    """Where the phrase starts in ``words``; only looked for in texts that contain it."""
    parts = phrase.split(" ")
    last = F.size(words) - F.lit(len(parts))
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(
        words, i + 1, F.lit(len(parts))) == F.array(*map(F.lit, parts)))
    return F.when(line.contains(f" {phrase} "), found).otherwise(F.array().cast("array<int>"))


def scan_bases(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Per row: number of words, base places and labels; ``words`` where a template is possible."""
    rows = docs.select("doc_id", F.array_remove(F.split(spaced(text_of()), " "), "").alias("words")).withColumn(
        "line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places = {label: _places(F.col("words"), F.col("line"), phrase) for phrase, label in PHRASES.items()}
    possible = F.lit(False)
    for must in sorted({t.must for t in templates}):
        told = F.lit(True)
        for word in must:
            told = told & F.col("line").contains(f" {word} ")
        possible = possible | told
    return rows.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.concat(*places.values()).alias("places"),
        F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for label, p in places.items()]),
                 lambda x: x.isNotNull()).alias("base"),
        F.when(possible, F.col("words")).alias("words"), F.monotonically_increasing_id().alias("rid"))


def template_hits(rows: DataFrame, known: Sequence[_Shape]) -> DataFrame:
    """(rid, at, word): the places of templates' words.  The vocabulary is a literal table."""
    vocabulary = sorted({w for s in known for w in s.words})
    table = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    return rows.where("words IS NOT NULL").select("rid", F.posexplode("words").alias("at", "word")).join(
        F.broadcast(table), "word").select("rid", "at", "word")


def global_order(hits: DataFrame) -> dict[str, int]:
    """Rank of the templates' words, rarest first; as many counts as the templates have words."""
    counts = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.word: i for i, r in enumerate(sorted(counts, key=lambda r: (r.n, r.word)))}


def matches(hits: DataFrame, templates: Sequence[Template] = TEMPLATES,
            containment: float = CONTAINMENT) -> DataFrame:
    """(rid, label, containment) of every template with a window that matches, at its best window."""
    known, rank = shapes(templates, containment), global_order(hits)
    prefixes, members = [], []
    for s in known:
        # A word without a place comes first; so does its place in the prefix, which it wastes.
        order = sorted(s.words, key=lambda w: (rank.get(w, -1), w))
        prefixes += [(w, s.number, i, s.need, s.reach) for i, w in enumerate(order[:len(order) - s.need + 1])]
        members += [(w, s.number, order.index(w)) for w in s.words]
    spark = hits.sparkSession
    prefix_table = F.broadcast(spark.createDataFrame(
        prefixes, "word string, template int, place int, need int, reach int"))
    member_table = F.broadcast(spark.createDataFrame(members, "word string, template int, place int"))
    cell = F.floor(F.col("at") / F.col("reach"))

    # Places of prefix words, and the template's hits in their cell and the two beside it.
    probes = hits.join(prefix_table, "word").select(
        "rid", "template", "at", "place", "need", "reach", cell.alias("cell"))
    reaches = F.broadcast(spark.createDataFrame([(s.number, s.reach) for s in known], "template int, reach int"))
    around = hits.join(member_table, "word").join(reaches, "template").select(
        "rid", "template", "word", F.col("at").alias("hit"), F.col("place").alias("hit_place"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = F.abs(F.col("hit") - F.col("at")) < F.col("reach")
    met = probes.join(around, ["rid", "template", "cell"]).where(near).groupBy(
        "rid", "template", "at", "place", "need", "reach").agg(
        F.collect_list(F.struct("hit", "word", "hit_place")).alias("region"))
    # Length: enough hits.  Position: enough distinct words, of which the candidate's is the first
    # in the order; a window whose first word is another has that word's place as its candidate.
    later = F.array_distinct(F.transform(F.filter(
        "region", lambda h: h.hit_place >= F.col("place")), lambda h: h.word))
    met = met.where((F.size("region") >= F.col("need")) & (F.size(later) >= F.col("need")))

    def window(start: Column) -> Column:
        """Distinct words of the template in the window that begins at ``start``."""
        inside = F.filter("region", lambda h: (h.hit >= start) & (h.hit < start + F.col("reach")))
        return F.array_distinct(F.transform(inside, lambda h: h.word))

    starts = F.array_distinct(F.transform(F.filter("region", lambda h: h.hit <= F.col("at")), lambda h: h.hit))
    told = spark.createDataFrame([(s.number, templates[s.number].label, s.must, len(s.words)) for s in known],
                                 "template int, label string, must array<string>, size int")
    windows = met.select("rid", "template", "need", F.explode(F.transform(starts, window)).alias("found"))
    return windows.where(F.size("found") >= F.col("need")).join(F.broadcast(told), "template").where(
        F.size(F.array_except("must", "found")) == 0).groupBy("rid", "label").agg(
        F.max(F.size("found") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """Every document with its base places and labels, and the labels of matching templates."""
    scanned = saved(scan_bases(docs, templates), "bases")
    hits = saved(template_hits(scanned, shapes(templates, containment)), "hits")
    found = matches(hits, templates, containment).groupBy("rid").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    none = F.array().cast("array<string>")
    return scanned.drop("words").join(found, "rid", "left").select(
        "doc_id", "n_words", "places", "base",
        F.array_union("base", F.coalesce("found", none)).alias("labels"),
        F.coalesce("containment", F.when(F.size("base") > 0, 1.0), F.lit(0.0)).alias("score"))


def license_digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort("labels"), ",").alias("labels"), "score")
