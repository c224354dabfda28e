"""The driver's tables in the shapes the operators work on.

==================  =======================================================================
``order_labels``    per order, the distinct types of its parts: a multi-valued label table
``user_events``     per event, its user and type: repeated keys, last row wins
``user_labels``     per user, the event types above their even share
``event_images``    events as images of their user
``event_scores``    one score per event and class
``vector_scores``   sigmoid of the similarity to each class centroid
``view_rows``       neighbouring vectors as the three views of a sample
``rasters``         8 x 8 RGB pixels derived from a vector
``step_log``        events as training steps
==================  =======================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.functions import bind, hash_uniform
from polybag.operators import labels as lab
from polybag.operators import scoring
from polybag.operators.skew import spread_join
from polybag.session import many_tasks, saved, scratch_path

EVENT_CLASSES = 5
VECTOR_CLASSES = 10
VECTOR_DIMS = 64
SIDE = 8
BATCH = 32
STEPS_PER_EPOCH = 500
ROW_GROUP = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- labels

def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    types = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    # The set of an order is bounded by the number of types and built before the shuffle.
    return types.groupBy(F.col("l_orderkey").alias("sid")).agg(
        F.array_join(F.sort_array(F.collect_set("p_type")), ";").alias("label")
    ).withColumn("ord", F.col("sid"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), F.col("event_type").alias("label"),
        F.col("event_id").alias("ord"))


def _user() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def user_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    per_user = counts.groupBy("user_id").agg(
        F.collect_list(F.struct("event_type", "n")).alias("types"), F.sum("n").alias("total"))
    frequent = F.filter("types", lambda t: t["n"] * EVENT_CLASSES > F.col("total"))
    names = F.sort_array(F.transform(frequent, lambda t: t["event_type"]))
    return per_user.where(F.size(names) > 0).select(
        _user().alias("sid"), F.array_join(names, ";").alias("label"),
        F.col("user_id").alias("ord"))


# ---------------------------------------------------------------- images and scores

def _path() -> Column:
    return F.concat(_user(), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg"))


def event_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(_user().alias("sid"), _path().alias("path"))


def event_scores(spark: SparkSession, sf_dir: str, vocabulary: list[str]) -> DataFrame:
    """(event_id, sid, path, event_type, scores), scores in vocabulary order."""
    def score(code: str) -> Column:
        own = (F.col("event_type") == code).cast("int")
        noise = hash_uniform("score", F.col("event_id"), code)
        return F.round(F.lit(0.25) + own * F.lit(0.5) + noise * F.lit(0.25), 6)

    return table(spark, sf_dir, "events").select(
        "event_id", _user().alias("sid"), _path().alias("path"), "event_type",
        F.array(*[score(c) for c in vocabulary]).alias("scores"))


def evaluated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, gt, scores, pred): each event against the labels of its user."""
    rows = saved(user_labels(spark, sf_dir), "labels")
    vocabulary = lab.vocabulary_codes(lab.top_labels(rows, EVENT_CLASSES))
    gt = lab.encode_labels(lab.filter_top_labels(rows, vocabulary), vocabulary)
    scores = event_scores(spark, sf_dir, vocabulary).select("event_id", "sid", "scores")
    joined = spread_join(scores, gt.select("sid", "gt"), "sid", "event_id")
    return scoring.with_predictions(joined.select("event_id", "gt", "scores"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of examples: (event_id, gt, scores, pred), all derived in the row.

    Class order is the alphabet of the types; an event's annotation is its own type.
    """
    source = table(spark, sf_dir, "events")
    return event_examples(
        spark.readStream.schema(source.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def event_batches(spark: SparkSession, sf_dir: str, batches: int) -> DataFrame:
    """The same stream in ``batches`` micro-batches: events by their id modulo that number.

    A batch is one file, of small row groups.  Few tasks read it, so its rows are dealt out before
    they are scored.
    """
    source, parts = table(spark, sf_dir, "events"), scratch_path(spark, "event-parts")
    part = F.col("event_id") % batches
    source.withColumn("part", part).repartition(part).write.partitionBy("part").option(
        "parquet.block.size", ROW_GROUP).parquet(parts)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(parts)
    return event_examples(stream.repartition(many_tasks(spark)))


def event_examples(stream: DataFrame) -> DataFrame:
    """Rows of events as evaluated examples."""
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    own = F.transform(types, lambda t: (F.col("event_type") == t).cast("int"))
    scores = F.transform(types, lambda t: (
        F.lit(0.3) * (F.col("event_type") == t).cast("int")
        + F.lit(0.7) * hash_uniform("stream", F.col("event_id"), t)))
    return scoring.with_predictions(
        stream.select("event_id", own.alias("gt"), scores.alias("scores")))


# ---------------------------------------------------------------- vectors

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def own_class() -> Column:
    """One-hot annotation of a vector's label."""
    return F.transform(F.sequence(F.lit(0), F.lit(VECTOR_CLASSES - 1)),
                       lambda c: (F.col("label") == c).cast("int"))


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, gt, scores): ten classes, annotated by the vector's own label."""
    rows = vectors(spark, sf_dir)
    scored = scoring.linear_scores(
        rows, scoring.class_centroids(rows, dims=VECTOR_DIMS), 60.0, -1.0, decimals=6)
    return scored.select("vec_id", own_class().alias("gt"), "scores")


def view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, sample_id, view, embedding): a vector is x of its own sample, y of the one
    before and z of the one before that (ids run from 0 to n-1)."""
    rows = vectors(spark, sf_dir)
    n = rows.agg(F.count(F.lit(1))).scalar()
    entries = F.array(*[
        F.struct(F.lit(v).alias("view"),
                 F.pmod(F.col("vec_id") - back, F.col("_n")).alias("sample_id"))
        for back, v in enumerate("xyz")])
    return (
        rows.withColumn("_n", n)
        .select("embedding", F.explode(entries).alias("_v"))
        .select(F.expr(f"_v.sample_id div {BATCH}").alias("batch_id"), "_v.sample_id", "_v.view",
                "embedding")
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, height, width, pixels): the channels read the 64 levels 21 apart."""
    level = F.transform("embedding", lambda v: F.floor(
        (v.cast("double") + 1) * 127.5).cast("int"))
    places = F.array(*[
        F.lit((i // 3 + i % 3 * 21) % VECTOR_DIMS) for i in range(SIDE * SIDE * 3)])
    cells = bind(level, lambda levels: F.transform(places, lambda p: F.get(levels, p)))
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"), cells.alias("pixels"))


# ---------------------------------------------------------------- runs

def step_log(events: DataFrame) -> DataFrame:
    """(run_id, ts, step, loss): four runs share the steps."""
    return events.select(
        F.concat(F.lit("run"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        "ts", (F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
