"""URL rules as intervals over reversed hosts, matched by one sorted sweep.

A rule ``host/path`` fits its host and every subdomain if the URL's path starts with its path.
With the host's labels reversed, a rule is a prefix of a key, and a prefix is the interval from
the prefix to the prefix followed by the largest byte.  A URL has a key for each suffix of its
host.  Rules' ends and URLs' keys are sorted together: an opening raises the depth of the stack,
an end lowers it, and slot ``d`` of the stack holds the rule opened last at depth ``d``.  A URL at
depth ``d`` lies in the rule of slot ``d``, the longest one for that suffix; the longest over all
suffixes wins.  The sweep runs in the pieces of a range partitioning; the depth and the stack at
a piece's start come from one row per piece (and depth).

A null URL, or one without ``://``, has empty host and path.  Equal rules with both verdicts
block.  Of two rules as long, that with the longer host wins.  Rules with a null are left out.  URLs
that no rule fits get the default verdict.  Repeated pages are rows like others; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polybag.llm.common import ROW, ascii_lower, kept_whole
from polybag.session import saved

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))
DEFAULT = "allow"
OPEN, URL, CLOSE = 0, 1, 2


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    if not rules:
        return spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        for rule, verdict in rules])))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _reversed_host(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    # A host has no slash, so the first one ends it.
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "utf-8")


def _events(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, kind, host, path, rule, verdict): ends of rules and keys of URLs."""
    split = F.instr("rule", "/")
    host = F.when(split > 0, F.substring(F.col("rule"), F.lit(1), split - 1)).otherwise(F.col("rule"))
    path = F.when(split > 0, F.substr(F.col("rule"), split)).otherwise("")
    known = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).groupBy(
        "rule").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("key", _key(_reversed_host(ascii_lower(host)), path))
    ends = known.select("rule", "verdict", F.inline(F.array(
        F.struct(F.col("key"), F.lit(OPEN).alias("kind")),
        F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(CLOSE).alias("kind")))))
    ends = ends.select("key", "kind", F.lit(None).cast("string").alias("host"),
                       F.lit(None).cast("string").alias("path"), "rule", "verdict")
    labels = _reversed_host(F.col("host"))
    levels = pairs.withColumn("labels", labels).withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    urls = levels.select(
        _key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"),
        F.lit(URL).alias("kind"), "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return urls.unionByName(ends)


def best_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) pairs to the longest rule that fits; pairs without one are left out."""
    order = ["key", "kind", "host", "path"]
    events = saved(
        _events(pairs, rules).repartitionByRange(*order)
        .withColumn("piece", F.spark_partition_id()), "sweep")
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    sums = events.groupBy("piece").agg(F.sum(step).alias("net"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    starts = sums.select("piece", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("start"))
    sweep = Window.partitionBy("piece").orderBy(*order)
    deep = events.withColumn(
        "net", F.sum(step).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    ).join(starts, "piece").withColumn("depth", F.col("start") + F.col("net")).where(
        (F.col("kind") != CLOSE) & (F.col("depth") > 0))
    opened = F.when(F.col("kind") == OPEN, F.struct("rule", "verdict"))
    slots = deep.groupBy("piece", "depth").agg(
        F.max(F.when(F.col("kind") == OPEN, F.struct("key", "rule", "verdict"))).alias("last"))
    below = Window.partitionBy("depth").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("piece", "depth", F.last(
        F.when(F.col("last").isNotNull(), F.struct("last.rule", "last.verdict")),
        ignorenulls=True).over(below).alias("carried"))
    slot = Window.partitionBy("piece", "depth").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    active = deep.withColumn("active", F.last(opened, ignorenulls=True).over(slot)).where(
        F.col("kind") == URL).join(carried, ["piece", "depth"]).withColumn(
        "active", F.coalesce("active", "carried"))
    best = active.groupBy("host", "path").agg(F.max(F.struct(
        F.length("active.rule").alias("rule_length"),
        F.instr("active.rule", "/").alias("host_length"),
        F.col("active.verdict").alias("verdict"), F.col("active.rule").alias("rule"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Every row as a struct, with ``host, path, rule, verdict``.

    The sweep takes each pair of host and path once, however many pages share it.
    """
    host, path = host_and_path(F.col("url"))
    rows = kept_whole(pages, host.alias("host"), path.alias("path"))
    pairs = pages.select(host.alias("host"), path.alias("path")).distinct()
    found = best_rules(pairs, rules)
    return rows.join(found, ["host", "path"], "left").select(
        ROW, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def url_digest(pages: DataFrame) -> DataFrame:
    judged = judge_urls(pages.select("page_id", "url"), rules_frame(pages.sparkSession))
    return judged.select(f"{ROW}.page_id", "host", "path", "rule", "verdict")
