"""Bags of instances: grouping, sizes, labels, padding.

An instance catalogue has columns ``sid`` and ``path``; only these travel through the
shuffles here.  Pixels or vectors are joined afterwards, by ``path``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polybag.functions import halve_to_fit, pad_array
from polybag.operators.skew import HEAVY_ROWS, Heavy, rank_within, spread_join


def entity_images(images: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Distinct (sid, path) rows; long form, so a large entity is never one array.

    ``carry`` names columns that follow from the path, such as its size.
    """
    return images.select("sid", "path", *carry).dropDuplicates(["sid", "path"])


def image_counts(images: DataFrame) -> DataFrame:
    """Distinct images per sid."""
    return entity_images(images).groupBy("sid").agg(F.count(F.lit(1)).alias("n_images"))


def missing_images(sids: DataFrame, images: DataFrame) -> DataFrame:
    """Sids without a single image: reported, where a directory listing would fail."""
    return sids.select("sid").join(images.select("sid").distinct(), "sid", "left_anti")


def bag_sizes(counts: DataFrame, max_bag: int) -> DataFrame:
    """Size and number of full bags, and the leftover, for each ``n_images``."""
    sized = counts.withColumn("bag_size", halve_to_fit("n_images", max_bag))
    return sized.withColumn("full_bags", F.expr("n_images div bag_size")).withColumn(
        "leftover", F.col("n_images") % F.col("bag_size"))


def make_bags(images: DataFrame, max_bag: int, distinct: bool = True,
              heavy_rows: int = HEAVY_ROWS, heavy: Heavy | None = None,
              carry: Sequence[str] = ()) -> DataFrame:
    """Assign every image to a bag: (sid, path, bag_no, bag_id, instance_no, carry).

    Images are taken in hash order of their path (the order of a set is arbitrary to begin
    with), which lets an entity with very many images be numbered by several tasks.  The
    leftover images form the last bag.
    """
    source = entity_images(images, carry) if distinct else images.select("sid", "path", *carry)
    ranked = rank_within(source, "sid", "path", rank="_r", total="_n",
                         heavy_rows=heavy_rows, heavy=heavy)
    return (
        ranked.withColumn("_size", halve_to_fit("_n", max_bag))
        .withColumn("bag_no", F.expr("_r div _size"))
        .withColumn("instance_no", F.col("_r") % F.col("_size"))
        .withColumn("bag_id", F.concat_ws("_", F.col("sid").cast("string"), F.col("bag_no")))
        .select("sid", "path", "bag_no", "bag_id", "instance_no", *carry)
    )


def bag_table(members: DataFrame) -> DataFrame:
    """One row per bag with its image list (at most ``max_bag`` entries) and ``nslice``."""
    listed = F.sort_array(F.collect_list(F.struct("instance_no", "path")))
    return (
        members.groupBy("bag_id", "sid", "bag_no")
        .agg(listed.alias("_m"))
        .select("bag_id", "sid", "bag_no",
                F.transform("_m", lambda m: m["path"]).alias("images"),
                F.size("_m").alias("nslice"))
    )


def bag_lengths(members: DataFrame) -> DataFrame:
    """One row per bag with ``nslice`` only, for jobs that do not need the paths."""
    return members.groupBy("bag_id", "sid", "bag_no").agg(
        F.count(F.lit(1)).cast("int").alias("nslice"))


def label_bags(bags: DataFrame, labels: DataFrame, heavy_rows: int = HEAVY_ROWS,
               heavy: Heavy | None = None) -> DataFrame:
    """Bags N:1 entity labels; an entity with very many bags is salted."""
    return spread_join(bags, labels, "sid", "bag_id", heavy_rows=heavy_rows, heavy=heavy)


def instance_labels(bags: DataFrame) -> DataFrame:
    """Train form: the bag's annotation repeated for each of its images."""
    kept = [c for c in bags.columns if c != "images"]
    return bags.select(*kept, F.posexplode("images").alias("instance_no", "path"))


def pad_bags(batched: DataFrame, filler: str = "") -> DataFrame:
    """Pad the image lists of a batch to its longest bag.  Batches are bounded by design."""
    longest = F.max("nslice").over(Window.partitionBy("batch_id"))
    return batched.withColumn("max_slice", longest).withColumn(
        "padded", pad_array("images", F.col("max_slice"), F.lit(filler)))
