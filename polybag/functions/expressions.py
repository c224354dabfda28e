"""Scalar and array expressions.  All of them stay on the JVM side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smoothing term of every ratio metric (fixed value).
EPSILON = 1e-8

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain reference inside an array lambda is evaluated again for each element.
    """
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- seeded draws

def hash_key(*parts: ColumnLike | int) -> Column:
    """md5 of the parts joined by ``:``; plain values are taken as literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash_uniform(*parts: ColumnLike | int) -> Column:
    """A draw from [0, 1) fixed by its key: the same on every cluster and after every retry."""
    head = F.substring(hash_key(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


# ---------------------------------------------------------------- labels

def label_codes(label: ColumnLike, separator: str = ";") -> Column:
    """The list of codes in a multi-valued label string; the separator is taken literally."""
    return F.split(_c(label), re.escape(separator))


def multi_hot(codes: ColumnLike, vocabulary: ColumnLike) -> Column:
    """0/1 per vocabulary position: is that label among the codes?"""
    return F.transform(_c(vocabulary), lambda v: F.array_contains(_c(codes), v).cast("int"))


# ---------------------------------------------------------------- bags

def halve_to_fit(n: ColumnLike, limit: int) -> Column:
    """Halve ``n`` (whole division) until it is at most ``limit``.

    Halving is a shift, so the number of steps follows from the two bit lengths: shifted to the
    length of ``limit``, ``n`` either fits or needs one step more.
    """
    n = _c(n).cast("bigint")
    surplus = F.length(F.bin(n)) - F.lit(int(limit).bit_length())
    aligned = F.call_function("shiftright", n, surplus)
    return F.when(n <= limit, n).when(aligned <= limit, aligned).otherwise(
        F.shiftright(aligned, 1))


def pad_array(values: ColumnLike, size: Column, filler: Column) -> Column:
    """Append ``filler`` until the array has ``size`` entries."""
    values = _c(values)
    missing = F.greatest(size - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(filler, missing))


def join_numbers(values: ColumnLike, separator: str = ",") -> Column:
    """An array of whole numbers as text."""
    return F.array_join(F.transform(_c(values), lambda v: v.cast("string")), separator)


# ---------------------------------------------------------------- scores and metrics

def adaptive_threshold(scores: ColumnLike, base: float = 0.5) -> Column:
    """0/1 per score: ``score >= min(largest score of the row, base)``.

    Every row gets at least one positive, and all ties at the largest score fire.
    """
    scores = _c(scores)
    return bind(
        F.least(F.array_max(scores), F.lit(float(base))),
        lambda cut: F.transform(scores, lambda s: (s >= cut).cast("int")),
    )


def sigmoid(x: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def logical_and(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) * _c(b)


def logical_or(a: ColumnLike, b: ColumnLike) -> Column:
    return F.greatest(_c(a), _c(b))


def logical_not(a: ColumnLike) -> Column:
    return F.lit(1) - _c(a)


def eps_ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    """``(part + eps) / (whole + eps)``: an empty label scores 1."""
    return (_c(part) + F.lit(EPSILON)) / (_c(whole) + F.lit(EPSILON))


def f1_score(precision: ColumnLike, recall: ColumnLike) -> Column:
    """Harmonic mean with the smoothing term in the denominator."""
    p, r = _c(precision), _c(recall)
    return F.lit(2.0) * p * r / (p + r + F.lit(EPSILON))


# ---------------------------------------------------------------- vectors

def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_normalize(v: ColumnLike) -> Column:
    """Unit-length copy of a vector; the entries of a zero vector become NULL."""
    v = _c(v)
    return bind(
        F.sqrt(dot(v, v)),
        lambda norm: F.transform(v, lambda x: F.try_divide(x.cast("double"), norm)),
    )
