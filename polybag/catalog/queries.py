"""``QUERIES``: name -> function(spark, sf_dir) -> DataFrame with plain columns.

Arrays are returned as text or as rows, and doubles rounded, so that results can be compared
with SQL value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.catalog import tables as t
from polybag.functions import dot, join_numbers, l2_normalize, label_codes
from polybag.operators import (
    auc, bags, batches, custom, labels as lab, losses, metrics, runs, scoring, splits, views,
)
from polybag.operators.skew import find_heavy
from polybag.plans import datasets, evaluate, probe
from polybag.session import many_tasks, saved, scratch_path
from polybag.sources import images as image_files
from polybag.sources import labels as label_files
from polybag.sources import manifest, retention, samples
from polybag.sources import runs as run_files
from polybag.sources.batches import read_batches
from polybag.streaming import epochs, progress
from polybag.streaming import evaluation as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOP_K = 4
DECIMALS = 9
# Means of six-decimal scores over at most 20 instances never end in a tie at 12 places.
POOL_DECIMALS = 12


def query(fn, name: str | None = None):
    QUERIES[name or fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *keys: str, decimals: int = DECIMALS) -> DataFrame:
    """Round every column that is not a key."""
    return df.select(*keys, *[
        F.round(c, decimals).alias(c) for c in df.columns if c not in keys])


def _text(values: str | Column) -> Column:
    return F.array_join(values, ";")


# ---------------------------------------------------------------- labels

@query
def scan_labels(spark, d):
    path = scratch_path(spark, "labels")
    label_files.write_labels(t.order_labels(spark, d), path)
    return label_files.scan_ordered(spark, path)


@query
def scan_label_files(spark, d):
    """Several files without an order column."""
    path = scratch_path(spark, "labels")
    rows = t.order_labels(spark, d).repartitionByRange(4, "ord").sortWithinPartitions("ord")
    rows.select(F.col("sid").cast("string").alias("Gene"), "label").write.csv(path, header=True)
    return label_files.scan_labels(spark, path)


@query
def explode_labels(spark, d):
    return lab.explode_labels(t.order_labels(spark, d)).select("sid", "pos", "code")


@query
def label_frequency(spark, d):
    return lab.label_frequency(t.order_labels(spark, d))


@query
def latest_labels(spark, d):
    return lab.latest_labels(t.user_events(spark, d))


@query
def top_labels(spark, d):
    return lab.top_labels(t.order_labels(spark, d), TOP_K)


@query
def filter_top_labels(spark, d):
    rows = saved(t.order_labels(spark, d), "labels")
    kept = lab.filter_top_labels(rows, lab.vocabulary_codes(lab.top_labels(rows, TOP_K)))
    return kept.select("sid", _text("codes").alias("codes"), F.size("codes").alias("n_codes"))


@query
def vocab_check(spark, d):
    return lab.vocabulary_check(lab.top_labels(t.order_labels(spark, d), 10), 10)


@query
def multi_hot(spark, d):
    rows = saved(t.order_labels(spark, d), "labels")
    vocabulary = lab.vocabulary_codes(lab.top_labels(rows, TOP_K))
    encoded = lab.encode_labels(lab.filter_top_labels(rows, vocabulary), vocabulary)
    return lab.long_annotations(encoded)


@query
def seeded_order(spark, d):
    return splits.seeded_order(t.table(spark, d, "documents").select("doc_id"), "doc_id")


@query
def split_assign(spark, d):
    return splits.split_assign(t.table(spark, d, "documents").select("doc_id"), "doc_id")


@query
def dataset_summary(spark, d):
    entities, _ = datasets.entity_table(saved(t.order_labels(spark, d), "labels"), TOP_K)
    return splits.split_summary(entities, 8)


@query
def split_label_counts(spark, d):
    entities, _ = datasets.entity_table(saved(t.order_labels(spark, d), "labels"), TOP_K)
    return splits.split_label_counts(entities)


# ---------------------------------------------------------------- bags and batches

@query
def gene_images(spark, d):
    return bags.entity_images(t.event_images(spark, d))


@query
def gene_image_counts(spark, d):
    return bags.image_counts(t.event_images(spark, d))


@query
def missing_images(spark, d):
    customers = t.table(spark, d, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("sid"))
    return bags.missing_images(customers, t.event_images(spark, d))


@query
def bag_size(spark, d):
    return bags.bag_sizes(bags.image_counts(t.event_images(spark, d)), 20)


@query
def make_bags(spark, d):
    return bags.make_bags(t.event_images(spark, d), 20)


@query
def bag_labels(spark, d):
    images = t.event_images(spark, d)
    heavy = find_heavy(images, "sid")
    members = bags.make_bags(images, 20, heavy=heavy)
    labelled = bags.label_bags(
        bags.bag_lengths(members), t.user_labels(spark, d), heavy=heavy)
    return labelled.select("bag_id", "sid", "bag_no", "nslice", "label")


@query
def bag_samples(spark, d):
    entities, _ = datasets.entity_table(saved(t.user_labels(spark, d), "labels"), TOP_K)
    samples = datasets.bag_samples(entities, t.event_images(spark, d), "test", batch_size=4)
    return samples.select("batch_id", "pos", "bag_id", "nslice", _text("images").alias("imgs"),
                          join_numbers("gt").alias("labels"))


@query
def val_samples(spark, d):
    entities, _ = datasets.entity_table(saved(t.user_labels(spark, d), "labels"), TOP_K)
    samples = datasets.bag_samples(entities, t.event_images(spark, d), "val")
    return samples.select("batch_id", "pos", "bag_id", "nslice", _text("images").alias("imgs"),
                          join_numbers("gt").alias("labels"))


@query
def collate_batches(spark, d):
    """Packed instances of both forms: annotated each, or by their bags."""
    entities, _ = datasets.entity_table(saved(t.user_labels(spark, d), "labels"), TOP_K)
    batched = saved(datasets.bag_samples(
        entities, t.event_images(spark, d), "test", batch_size=4), "samples")
    instances, bagged = batches.collate(batched, 20)
    return instances.select(
        F.lit("instance").alias("part"), "batch_id", "row_no", "bag_id", "path",
        join_numbers("gt").alias("labels")).unionByName(bagged.select(
            F.lit("bag").alias("part"), "batch_id", F.col("offset").cast("bigint").alias("row_no"), "bag_id",
            F.lit(None).cast("string").alias("path"), join_numbers("gt").alias("labels")))


@query
def train_samples(spark, d):
    entities, _ = datasets.entity_table(saved(t.user_labels(spark, d), "labels"), TOP_K)
    samples = datasets.bag_samples(entities, t.event_images(spark, d), "train")
    return bags.instance_labels(samples).select(
        "batch_id", "pos", "bag_id", "path", join_numbers("gt").alias("labels"))


def _batched_bags(spark, d, listed: bool = False) -> DataFrame:
    members = bags.make_bags(t.event_images(spark, d), 20)
    table = bags.bag_table(members) if listed else bags.bag_lengths(members)
    return batches.assign_batches(table, 8)


@query
def pad_bags(spark, d):
    return bags.pad_bags(_batched_bags(spark, d, listed=True)).select(
        "batch_id", "pos", "bag_id", "nslice", "max_slice", _text("padded").alias("padded"))


@query
def assign_batches(spark, d):
    lengths = bags.bag_lengths(bags.make_bags(t.event_images(spark, d), 20))
    columns = ["batch_id", "pos", "bag_id"]
    lexical = batches.assign_batches(lengths, 8).select(F.lit("lexical").alias("kind"), *columns)
    shuffled = batches.assign_batches(lengths, 8, "shuffled").select(
        F.lit("shuffled").alias("kind"), *columns)
    return lexical.unionByName(shuffled)


@query
def batch_stats(spark, d):
    return batches.batch_stats(_batched_bags(spark, d))


@query
def segment_offsets(spark, d):
    return batches.segment_offsets(_batched_bags(spark, d)).select(
        "batch_id", "pos", "bag_id", "nslice", "offset")


@query
def balance_batches(spark, d):
    balanced = batches.balance_batches(_batched_bags(spark, d))
    return balanced.groupBy("batch_id").agg(
        F.sum(F.when(F.col("half") == 0, F.col("nslice")).otherwise(0)).alias("half_sum"),
        F.sum("nslice").alias("total"), F.count(F.lit(1)).alias("n_bags"))


@query
def balanced_order(spark, d):
    return batches.balance_batches(_batched_bags(spark, d))


# ---------------------------------------------------------------- evaluation

def _bag_evaluation(spark, d) -> DataFrame:
    """Test bags: pooled event scores against the labels of the user."""
    entities, vocabulary = datasets.entity_table(
        saved(t.user_labels(spark, d), "labels"), t.EVENT_CLASSES)
    members, chosen, heavy = datasets.mode_members(entities, t.event_images(spark, d), "test")
    instances = evaluate.instance_scores(members, t.event_scores(spark, d, vocabulary), chosen)
    return saved(evaluate.evaluated_bags(
        instances, chosen, t.EVENT_CLASSES, POOL_DECIMALS, heavy), "evaluated")


@query
def bag_scores(spark, d):
    vocabulary = lab.vocabulary_codes(
        lab.top_labels(t.user_labels(spark, d), t.EVENT_CLASSES))
    members = bags.make_bags(t.event_images(spark, d), 20).select("bag_id", "path")
    scored = t.event_scores(spark, d, vocabulary).select("path", "scores")
    pooled = scoring.bag_scores(
        members.join(scored, "path"), t.EVENT_CLASSES, decimals=POOL_DECIMALS)
    return pooled.select("bag_id", "nslice", F.posexplode("scores").alias("label_idx", "score"))


@query
def adaptive_threshold(spark, d):
    evaluated = scoring.with_predictions(t.vector_scores(spark, d))
    return evaluated.select(
        "vec_id", F.posexplode(F.arrays_zip("scores", "pred")).alias("label_idx", "_c")
    ).select("vec_id", "label_idx", F.col("_c.scores").alias("score"),
             F.col("_c.pred").alias("pred"))


@query
def confusion_counts(spark, d):
    return metrics.confusion_counts(t.evaluated_events(spark, d))


@query
def example_metrics(spark, d):
    return _rounded(metrics.example_metrics(t.evaluated_events(spark, d)))


@query
def label_macro_metrics(spark, d):
    return _rounded(metrics.label_macro_metrics(
        metrics.confusion_counts(t.evaluated_events(spark, d))))


@query
def label_micro_metrics(spark, d):
    return _rounded(metrics.label_micro_metrics(
        metrics.confusion_counts(t.evaluated_events(spark, d))))


@query
def per_label_metrics(spark, d):
    return _rounded(metrics.per_label_metrics(
        metrics.confusion_counts(t.evaluated_events(spark, d))), "label_idx")


@query
def f1_zero_division(spark, d):
    return _rounded(metrics.f1_zero_division(
        metrics.confusion_counts(t.evaluated_events(spark, d))))


def _label_auc(evaluated: DataFrame) -> DataFrame:
    return auc.auc_per_label(auc.score_counts(auc.score_cells(evaluated)))


@query
def auc_per_label(spark, d):
    areas = _label_auc(t.evaluated_events(spark, d)).where(F.col("label_idx") != auc.POOLED)
    return _rounded(areas, "label_idx", "p", "n")


@query
def auc_macro(spark, d):
    return _rounded(auc.auc_macro(_label_auc(t.evaluated_events(spark, d))))


@query
def auc_micro(spark, d):
    return _rounded(auc.auc_micro(t.evaluated_events(spark, d)))


@query
def vector_auc(spark, d):
    return _rounded(auc.both_aucs(t.vector_scores(spark, d)))


@query
def eval_report(spark, d):
    return _rounded(evaluate.full_report(_bag_evaluation(spark, d)), "metric", "label_idx")


@query
def eval_report_brief(spark, d):
    return _rounded(evaluate.brief_report(_bag_evaluation(spark, d)), "metric", "label_idx")


@query
def report_text(spark, d):
    report = saved(_rounded(evaluate.full_report(_bag_evaluation(spark, d)), "metric", "label_idx"), "report")
    parts = [run_files.report_lines(report, layout).select(F.lit(layout).alias("layout"), "line_no", "line")
             for layout in ("full", "brief", "score")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def positive_slices(spark, d):
    sliced = runs.positive_slices(t.evaluated_events(spark, d), t.EVENT_CLASSES)
    return sliced.withColumn("mean_score", F.round("mean_score", DECIMALS))


@query
def custom_metric(spark, d):
    """Two metrics of a user's own, over tenths of the events and over all."""
    evaluated = saved(t.evaluated_events(spark, d), "evaluated")
    both = custom.Together(custom.HammingLoss(), custom.OneError())
    tenth = (F.col("event_id") % 10).cast("string").alias("part")
    parts = custom.custom_metric(evaluated.select("*", tenth), both, ["part"])
    whole = custom.custom_metric(evaluated, both).select(F.lit("all").alias("part"), "metric", "value")
    return _rounded(parts.unionByName(whole), "part", "metric")


@query
def matched_examples(spark, d):
    """Annotations and predictions of documents, each of which lacks some of the others' keys."""
    rows = t.table(spark, d, "labels")
    annotations = rows.where("doc_id % 7 <> 0").select("doc_id", "quality")
    predictions = rows.where("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("pred"))
    lost = scoring.unmatched(annotations, predictions, "doc_id").select(
        "doc_id", F.lit(None).cast("int").alias("agree"), "sides")
    both = scoring.align(annotations, predictions, "doc_id").select(
        "doc_id", (F.col("quality") == F.col("pred")).cast("int").alias("agree"), F.lit(3).alias("sides"))
    return both.unionByName(lost)


# ---------------------------------------------------------------- losses

@query
def score_samples(spark, d):
    return t.vector_scores(spark, d).select(
        "vec_id", F.posexplode("scores").alias("label_idx", "score"))


def _unit_vectors(spark, d):
    scaled = t.vectors(spark, d).select("vec_id", F.transform(
        "embedding", lambda v: v.cast("double") * (F.col("vec_id") % 7 + 1)).alias("raw"))
    return scaled.select(
        "vec_id", F.posexplode(l2_normalize("raw")).alias("pos", "value")
    ).withColumn("value", F.round("value", DECIMALS))


query(_unit_vectors, "l2_normalize")


@query
def view_align(spark, d):
    aligned = losses.align_views(t.view_rows(spark, d))
    products = [F.round(dot(a, b), DECIMALS).alias(a + b) for a, b in ("xy", "xz", "yz")]
    return aligned.select("batch_id", "sample_id", *products)


def _similarities(spark, d) -> DataFrame:
    return losses.anchor_similarities(t.view_rows(spark, d))


@query
def pairwise_similarity(spark, d):
    return _rounded(losses.similarity_rows(_similarities(spark, d)),
                    "batch_id", "sample_id", "matrix", decimals=6)


@query
def bce_loss(spark, d):
    cells = auc.score_cells(t.evaluated_events(spark, d)).withColumn(
        "weight", F.col("label_idx") + 1.0)
    terms = losses.bce_terms(losses.bce_terms(cells, out="plain"), weight="weight", out="weighted")
    return _rounded(terms.groupBy("label_idx").agg(
        F.avg("plain").alias("mean"), F.sum("plain").alias("sum"),
        F.avg("weighted").alias("weighted_mean")), "label_idx", decimals=6)


@query
def contrastive_mutual(spark, d):
    terms = losses.contrastive_terms(_similarities(spark, d))
    return _rounded(terms.select("batch_id", "mutual"), "batch_id")


@query
def contrastive_aux(spark, d):
    terms = losses.contrastive_terms(_similarities(spark, d))
    return _rounded(terms.drop("mutual"), "batch_id")


@query
def contrastive_loss(spark, d):
    return _rounded(losses.contrastive_loss(_similarities(spark, d)), "batch_id")


# ---------------------------------------------------------------- image files

def _image_files(spark, d) -> str:
    """Vectors as bitmaps, a folder per label, and the text of each nation's name as a bad file."""
    root = scratch_path(spark, "images")
    good = t.rasters(spark, d).join(
        t.vectors(spark, d).select(F.col("vec_id").alias("image_id"), "label"), "image_id").select(
        F.col("label").cast("string").alias("sid"),
        F.concat(F.col("image_id").cast("string"), F.lit(".bmp")).alias("name"),
        "height", "width", "pixels")
    image_files.write_bitmaps(views.with_bytes(good), root)
    t.table(spark, d, "nation").select(
        F.col("n_regionkey").alias("sid"), F.col("n_name").alias("value")).repartition(1).write.partitionBy(
        "sid").option("compression", "none").mode("append").text(f"{root}/bad")
    return root


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


@query
def scan_images(spark, d):
    listed = image_files.scan_images(spark, _image_files(spark, d), "*.bmp")
    return listed.select("sid", _name().alias("name"), "length")


@query
def decode_images(spark, d):
    decoded = image_files.decode_images(spark, _image_files(spark, d), "*.bmp")
    return views.with_levels(decoded).select(
        "sid", _name().alias("name"), "height", "width", join_numbers("pixels").alias("pixels"))


@query
def undecodable_images(spark, d):
    return image_files.undecodable_images(spark, _image_files(spark, d), "*.{bmp,txt}").groupBy(
        F.element_at(F.split("sid", "="), -1).alias("sid")).agg(F.count(F.lit(1)).alias("n"))


@query
def image_manifest(spark, d):
    """Folders listed in two calls, the second of all folders: it lists those the first had not."""
    root, path = _image_files(spark, d), scratch_path(spark, "manifest")
    folders = manifest.child_folders(spark, root).where(~F.col("folder").endswith("/bad"))
    even = F.element_at(F.split("folder", "/"), -1).cast("int") % 2 == 0
    manifest.extend_manifest(folders.where(even), path, 1, "*.bmp")
    manifest.extend_manifest(folders, path, 2, "*.bmp")
    return read_batches(spark, path, manifest.FILES).where("path IS NOT NULL").select(
        "sid", _name().alias("name"), "length", "batch")


@query
def fetch_samples(spark, d):
    """Every fiftieth vector by its id, from the files that hold them."""
    path, rows = scratch_path(spark, "samples"), t.vectors(spark, d).select("vec_id", "label", "embedding")
    samples.write_samples(rows, path, "vec_id", 32)
    ids = range(0, rows.agg(F.max("vec_id")).first()[0] + 1, 50)
    found = samples.fetch_samples(spark, path, "vec_id", list(ids))
    return found.select("vec_id", "label", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), DECIMALS))


# ---------------------------------------------------------------- views

def _event_catalogue(spark, d) -> DataFrame:
    """Events as images of varying size."""
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("image_id"),
        F.lit(512).alias("height"),
        (F.lit(512) + (F.col("user_id") % 3) * 64).cast("int").alias("width"))


@query
def augmentation_plan(spark, d):
    return _rounded(views.augmentation_plan(_event_catalogue(spark, d)),
                    "image_id", "view", "slot", "op", "sign", decimals=6)


@query
def view_plan(spark, d):
    plan = views.view_plan(_event_catalogue(spark, d), ("basic1", "basic2", "aux", "eval"))
    return plan.select(*[
        F.round(c, 6).alias(c) if c in ("brightness", "contrast", "saturation", "hue") else c
        for c in plan.columns])


@query
def augment_views(spark, d):
    done = views.augment_views(t.rasters(spark, d), ("aux",), as_levels=True)
    return done.select(
        "image_id", "view", join_numbers("pixels").alias("pixels"))


@query
def augment_once(spark, d):
    done = views.augment_views(t.rasters(spark, d), ("aux",), n=1, as_levels=True)
    return done.select(
        "image_id", "view", join_numbers("pixels").alias("pixels"))


@query
def render_views(spark, d):
    done = views.render_views(t.rasters(spark, d), size=t.SIDE)
    total = F.aggregate("payload", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return done.select("image_id", "view", F.size("payload").alias("n_values"),
                       F.round(total, 3).alias("total"))


@query
def eval_views(spark, d):
    done = views.render_views(t.rasters(spark, d), ("eval",), size=t.SIDE)
    return done.select(
        "image_id", F.posexplode("payload").alias("pos", "value")
    ).withColumn("value", F.round(F.col("value").cast("double"), 4))


# Magnitudes as drawn for strength 10 (fixed values), except where noted in the operator.
POINTWISE = [("Invert", 0.0), ("Solarize", 256 / 3.0), ("SolarizeAdd", 110 / 3.0),
             ("Posterize", 4 / 3.0), ("AutoContrast", 0.0), ("Brightness", 0.5),
             ("Contrast", 0.5), ("Color", 0.5), ("Identity", 0.0)]
NEIGHBOURS = [("ToBLUR", 0.0), ("ToCONTOUR", 0.0), ("ToEMBOSS", 0.0), ("ToEDGES", 0.0),
              ("Sharpness", 0.5)]
MOVES = [("ShearX", 0.25), ("ShearY", 0.25), ("TranslateXabs", 3.0), ("TranslateYabs", -2.0),
         ("TranslateX", 0.25), ("TranslateY", -0.25), ("Flip", 0.0), ("Rotate", 30.0),
         ("CutoutAbs", 3.0)]


def _kernels(spark, d, chosen) -> DataFrame:
    done = views.apply_kernels(t.rasters(spark, d), chosen, as_levels=True)
    return done.select(
        "image_id", F.col("view").alias("op"), join_numbers("pixels").alias("pixels"))


@query
def pointwise_kernels(spark, d):
    return _kernels(spark, d, POINTWISE)


@query
def neighbour_kernels(spark, d):
    return _kernels(spark, d, NEIGHBOURS)


@query
def geometric_kernels(spark, d):
    return _kernels(spark, d, MOVES)


@query
def normalize_pixels(spark, d):
    done = views.normalize_pixels(t.rasters(spark, d))
    return done.select("image_id", F.posexplode("tensor").alias("pos", "value")).withColumn(
        "value", F.round("value", DECIMALS))


@query
def sample_pairing(spark, d):
    done = views.sample_pairing(t.rasters(spark, d), 0.25)
    return done.select("image_id", "partner_id", join_numbers("pixels").alias("pixels"))


@query
def channel_means(spark, d):
    return _rounded(views.channel_means(t.rasters(spark, d)), "image_id", "channel")


@query
def pretrain_samples(spark, d):
    """One row per sample and view, with every planned choice."""
    entities, _ = datasets.entity_table(saved(t.user_labels(spark, d), "labels"), TOP_K)
    images = t.event_images(spark, d).withColumns({
        "height": F.lit(512),
        "width": (F.lit(512) + F.substring("sid", 2, 20).cast("bigint") % 3 * 64).cast("int")})
    rows = datasets.pretrain_samples(entities, images)
    each = F.explode(F.array(*[f"img_{v}" for v in views.PRETRAIN_VIEWS]))
    plain = ["frame_h", "frame_w", "box_x", "box_y", "box_w", "box_h", "gray", "flip"]
    drawn = ["brightness", "contrast", "saturation", "hue"]

    def slot(i: int, field: str) -> Column:
        return F.get("_v.ops", F.lit(i))[field]

    return rows.select("batch_id", "pos", "bag_id", "image_id", "label", each.alias("_v")).select(
        "batch_id", "pos", "bag_id", "image_id", "_v.view", *[f"_v.{c}" for c in plain],
        *[F.round(f"_v.{c}", 6).alias(c) for c in drawn],
        *[slot(i, "op").alias(f"op{i}") for i in range(views.SLOTS)],
        *[F.round(slot(i, "magnitude"), 6).alias(f"magnitude{i}") for i in range(views.SLOTS)],
        join_numbers("label").alias("label"))


# ---------------------------------------------------------------- runs

@query
def parse_run_log(spark, d):
    events = t.table(spark, d, "events")
    epoch = F.expr(f"event_id div {t.STEPS_PER_EPOCH} + 1")
    # Every third event logs an evaluation line instead, every seventh is noise.
    loss = F.concat(
        F.lit("2021-01-15 00:11:06,861 - INFO: the "), epoch.cast("string"),
        F.lit(" epoch's resnet result:  training loss "), F.col("value").cast("string"),
        F.lit(",training per step cost 0.23 s, total_cost 763.72 s"))
    scored = F.concat(
        F.lit("2020-12-18 23:25:39,857 - INFO: the "), epoch.cast("string"),
        F.lit(" epoch's Eval result: f1_macro 0.2911, f1_micro 0.5977, auc "),
        (F.col("event_id") % 1000 / 1000.0).cast("decimal(4,3)").cast("string"),
        F.lit(",eval cost 365.93 s"))
    lines = events.select(
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("starting "), F.col("event_type")))
        .when(F.col("event_id") % 3 == 0, scored).otherwise(loss).alias("value"))
    parsed = runs.parse_run_log(lines).groupBy("kind", "epoch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"),
        F.avg("cost_seconds").alias("cost_seconds"), F.avg("auc").alias("auc"),
        F.min("ts").alias("ts"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts")
    return parsed.select("kind", "epoch", "n", stamp, *[
        F.round(c, 6).alias(c) for c in ("loss", "cost_seconds", "auc")])


@query
def epoch_loss(spark, d):
    log = t.step_log(t.table(spark, d, "events"))
    return _rounded(runs.epoch_loss(log, t.STEPS_PER_EPOCH), "run_id", "epoch", "steps",
                    decimals=6)


@query
def epoch_eval(spark, d):
    evaluated = t.evaluated_events(spark, d).withColumn(
        "epoch", F.expr(f"event_id div {t.STEPS_PER_EPOCH} + 1"))
    chosen = runs.evaluated_epochs(evaluated, 2)
    return _rounded(evaluate.headline(chosen, ["epoch"]), "epoch")


@query
def keep_latest(spark, d):
    log = t.step_log(t.table(spark, d, "events"))
    saved = log.select("run_id", runs.epoch_of("step", t.STEPS_PER_EPOCH).alias("epoch"),
                       "step").groupBy("run_id", "epoch").agg(F.max("step").alias("step"))
    return runs.keep_latest(saved)


@query
def append_run_log(spark, d):
    """Ten batches of epochs, each written twice, read once."""
    path, log = scratch_path(spark, "run-log"), t.step_log(t.table(spark, d, "events"))
    rows = saved(runs.epoch_loss(log, t.STEPS_PER_EPOCH), "epoch-loss")
    for attempt in range(2):
        for batch in range(10):
            run_files.append_run_log(rows.where(F.col("epoch") % 10 == batch), path, f"job {d}", batch)
    table = read_batches(spark, path, rows.schema)
    return _rounded(table.select("run_id", "epoch", "batch", "steps", "loss"), "run_id", "epoch", "batch",
                    "steps", decimals=6)


@query
def append_report(spark, d):
    """The evaluation of every second epoch, appended by two attempts of a job."""
    path = scratch_path(spark, "reports")
    evaluated = t.evaluated_events(spark, d).withColumn(
        "epoch", F.expr(f"event_id div {t.STEPS_PER_EPOCH} + 1"))
    report = saved(evaluate.headline(runs.evaluated_epochs(evaluated, 2), ["epoch"]), "headline")
    for attempt in range(2):
        for batch in range(2):
            run_files.append_report(report.where(F.col("epoch") % 4 == 2 * batch), path, "eval", batch)
    table = read_batches(spark, path, report.schema)
    return _rounded(table.drop("writer"), "epoch", "batch")


@query
def expire_outputs(spark, d):
    """Outputs of each run and epoch are written as folders; the newest two of a run are left."""
    root, log = scratch_path(spark, "outputs"), t.step_log(t.table(spark, d, "events"))
    steps = log.withColumn("epoch", runs.epoch_of("step", t.STEPS_PER_EPOCH)).select("run_id", "epoch", "step")
    # A folder costs more than its few rows: tasks are not to be merged by their bytes.
    steps.repartition(many_tasks(spark), "run_id", "epoch").write.partitionBy("run_id", "epoch").parquet(root)
    retention.expire_outputs(spark, root, keep=2)
    left = spark.read.schema(steps.schema).option("basePath", root).parquet(root)
    return left.groupBy("run_id", "epoch").agg(F.count(F.lit(1)).alias("steps"), F.max("step").alias("last_step"))


@query
def run_manifest(spark, d):
    rows = t.table(spark, d, "events").select(
        "event_id",
        F.create_map(F.lit("k"), F.lit("default"), F.lit("type"), F.col("event_type"))
        .alias("config"),
        F.from_json("props", "map<string,string>").alias("args"))
    merged = runs.run_manifest(rows)
    return merged.select("event_id", F.explode("manifest").alias("name", "setting"))


# ---------------------------------------------------------------- streams

@query
def stream_confusion(spark, d):
    return live.final_state(spark, live.confusion_state(t.stream_events(spark, d)))


@query
def stream_metrics(spark, d):
    return _rounded(live.evaluated_stream(t.stream_events(spark, d)), "metric", "label_idx")


@query
def stream_epoch_eval(spark, d):
    """Every second epoch of a running stream is evaluated; others are never counted."""
    stream = t.stream_events(spark, d).withColumn(
        "epoch", F.expr(f"event_id div {t.STEPS_PER_EPOCH} + 1"))
    report = live.evaluated_stream(runs.evaluated_epochs(stream, 2), ["epoch"])
    return _rounded(report.where("label_idx IS NULL").drop("label_idx"), "epoch", "metric")


@query
def stream_metrics_in_batches(spark, d):
    """Eight batches, with runs folded by four: the report is that of one batch."""
    evaluator = live.StreamEvaluator(t.event_batches(spark, d, 8), scratch_path(spark, "evaluation"), fan=4)
    evaluator.start().awaitTermination()
    return _rounded(evaluator.report(), "metric", "label_idx")


@query
def stream_epoch_loss(spark, d):
    schema = t.table(spark, d, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(d))
    found = epochs.epochs_so_far(t.step_log(stream), t.STEPS_PER_EPOCH)
    return _rounded(found.select("run_id", "epoch", "steps", "loss"), "run_id", "epoch", "steps", decimals=6)


@query
def stream_progress_log(spark, d):
    """Input rows per batch, as a listener has logged them: one event per batch of a part."""
    root = scratch_path(spark, "progress")
    evaluator = live.StreamEvaluator(t.event_batches(spark, d, 8), scratch_path(spark, "evaluation"))
    with progress.ProgressLog(spark, root) as log:
        log.wait(evaluator.start())
    rows = progress.progress_rows(spark, root).where("input_rows > 0")
    return rows.groupBy("input_rows").agg(F.count(F.lit(1)).alias("batches"))


# ---------------------------------------------------------------- linear probe

@query
def linear_probe(spark, d):
    annotated = t.vectors(spark, d).select("vec_id", "embedding", t.own_class().alias("gt"))
    split = splits.split_assign(annotated, "vec_id")
    weights, intercepts = probe.fit_probe(
        splits.in_split(split, "train"), t.VECTOR_CLASSES, iterations=10)
    scored = scoring.apply_scorer(
        splits.in_split(split, "test").select("vec_id", "gt", "embedding"),
        probe.probe_scorer(weights, intercepts))
    report = evaluate.full_report(saved(scoring.with_predictions(scored), "evaluated"))
    return _rounded(report, "metric", "label_idx", decimals=6)


@query
def probe_data(spark, d):
    """What the probe is fitted and judged on: vectors per split and class."""
    split = splits.split_assign(t.vectors(spark, d), "vec_id")
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- another label table

@query
def document_labels(spark, d):
    """Documents' flags as a two-class annotation, through the same text form; none is empty."""
    text = F.concat_ws(";", F.when(F.col("quality") == 1, "quality"),
                       F.when(F.col("toxic") == 1, "toxic"))
    classes = ["quality", "toxic"]
    rows = t.table(spark, d, "labels").select(
        F.col("doc_id").alias("sid"), text.alias("label"), F.col("doc_id").alias("ord"))
    codes = F.filter(label_codes("label"), lambda c: c.isin(classes))
    encoded = lab.encode_labels(rows.withColumn("codes", codes), classes)
    return encoded.select("sid", F.size("codes").alias("n"), "label", join_numbers("gt").alias("gt"))
