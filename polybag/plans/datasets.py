"""Build the datasets of the three training modes from labels and an image catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polybag.operators import bags, batches, labels as lab, splits, views
from polybag.operators.skew import HEAVY_ROWS, Heavy, find_heavy, spread_join
from polybag.session import saved

# Shipped settings (fixed values): largest bag, bags per batch and batch order of each mode.
MODES = {
    "pretrain": {"max_bag": 1, "batch_size": 32, "order": "shuffled"},
    "train": {"max_bag": 1, "batch_size": 8, "order": "shuffled"},
    "val": {"max_bag": 20, "batch_size": 1, "order": "lexical"},
    "test": {"max_bag": 20, "batch_size": 1, "order": "lexical"},
}
CLASSES = 10


def entity_table(label_rows: DataFrame, k: int = CLASSES) -> tuple[DataFrame, list[str]]:
    """(entities, vocabulary): one row per kept sid with ``codes``, ``gt`` and ``split``.

    The entities are written once: every mode then reads the same split.  ``label_rows`` is
    read several times, so it should be a stored table.
    """
    vocabulary = lab.vocabulary_codes(lab.top_labels(label_rows, k))
    kept = lab.filter_top_labels(lab.latest_labels(label_rows), vocabulary)
    encoded = lab.encode_labels(kept, vocabulary).select("sid", "codes", "gt")
    return saved(splits.split_assign(encoded), "entities"), vocabulary


def mode_members(entities: DataFrame, images: DataFrame, mode: str, max_bag: int | None = None,
                 heavy_rows: int = HEAVY_ROWS,
                 carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, Heavy]:
    """(members, annotations, heavy) of one mode's split.

    The split is applied to the catalogue before bagging, so other splits' images are not
    sorted.  One count of images per entity finds the heavy ones for all the steps here.
    ``carry`` names columns of the catalogue that stay with an image.
    """
    heavy = find_heavy(images, "sid", heavy_rows)
    chosen = splits.in_split(entities, mode).select("sid", "gt")
    wanted = spread_join(images, chosen.select("sid"), "sid", "path",
                         heavy_rows=heavy_rows, heavy=heavy)
    members = bags.make_bags(wanted, max_bag or MODES[mode]["max_bag"],
                             heavy_rows=heavy_rows, heavy=heavy, carry=carry)
    return members, chosen, heavy


def labelled_bags(entities: DataFrame, images: DataFrame, mode: str,
                  max_bag: int | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Bags of one mode with their annotation: (bag_id, sid, bag_no, images, nslice, gt)."""
    members, chosen, heavy = mode_members(entities, images, mode, max_bag, heavy_rows)
    return bags.label_bags(bags.bag_table(members), chosen, heavy_rows, heavy)


def bag_samples(entities: DataFrame, images: DataFrame, mode: str,
                max_bag: int | None = None, batch_size: int | None = None,
                order: str | None = None) -> DataFrame:
    """Batched samples: (batch_id, pos, bag_id, images, nslice, gt)."""
    settings = MODES[mode]
    table = saved(labelled_bags(entities, images, mode, max_bag), "bags")
    # Ids alone are ordered; the image lists are written once and meet them by id.
    ranked = batches.assign_batches(
        table.select("bag_id"), batch_size or settings["batch_size"], order or settings["order"])
    return ranked.join(table, "bag_id").select(
        "batch_id", "pos", "bag_id", "images", "nslice", "gt")


def collated_samples(entities: DataFrame, images: DataFrame, mode: str, max_bag: int | None = None,
                     batch_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, bags) of a mode's batches; training repeats the annotation per instance."""
    batched = saved(bag_samples(entities, images, mode, max_bag, batch_size), "samples")
    return batches.collate(batched, max_bag or MODES[mode]["max_bag"], mode == "train")


def pretrain_samples(entities: DataFrame, images: DataFrame,
                     batch_size: int | None = None) -> DataFrame:
    """One row per image of the train split with the plans of its three views.

    ``images`` also has ``height`` and ``width``.  Columns ``img_basic1, img_basic2, img_aux`` are
    structs of every choice of the view: box, jitter, grey and flip flags, and for the auxiliary
    view ``ops`` with operation, signed magnitude and draws; ``label`` is the annotation.  They are
    what :func:`polybag.operators.views.render_views` draws for an image with this path as its key.
    """
    # Bags of one image: bag and image coincide, so no list has to be packed and unpacked.
    members, chosen, heavy = mode_members(entities, images, "pretrain", carry=("height", "width"))
    table = saved(bags.label_bags(members, chosen, heavy=heavy), "samples")
    batched = batches.assign_batches(
        table, batch_size or MODES["pretrain"]["batch_size"], "shuffled")
    planned = views.with_choices(batched, views.PRETRAIN_VIEWS, "path")

    def whole(view: str):
        augmented = "augment" in views.RECIPES[view]
        ops = views.planned_operations(view, "path")
        return F.struct(f"plan_{view}.*", (ops if augmented else F.slice(ops, 1, 0)).alias("ops"))

    return planned.select(
        "batch_id", "pos", "bag_id", F.col("path").alias("image_id"), F.col("gt").alias("label"),
        *[whole(v).alias(f"img_{v}") for v in views.PRETRAIN_VIEWS])
