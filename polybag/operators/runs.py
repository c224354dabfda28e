"""Run logs, epochs, checkpoints and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of the two log lines (fixed values).
LOSS_LINE = (
    r"the (\d+) epoch's resnet result:\s+training loss ([-+.\deE]+|nan|inf),"
    r"training per step cost ([.\d]+) s, total_cost ([.\d]+) s"
)
EVAL_LINE = (
    r"the (\d+) epoch's Eval result: f1_macro ([-+.\deE]+), f1_micro ([-+.\deE]+), "
    r"auc ([-+.\deE]+),eval cost ([.\d]+) s"
)
TIME_PREFIX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3})"


def epoch_of(step: str | Column, steps_per_epoch: int) -> Column:
    """1-based epoch of a 1-based step."""
    step = F.col(step) if isinstance(step, str) else step
    return F.floor((step - 1) / steps_per_epoch).cast("bigint") + 1


def _part(pattern: str, group: int, kind: str) -> Column:
    text = F.regexp_extract("value", pattern, group)
    return F.when(text != "", text).try_cast(kind)


def parse_run_log(lines: DataFrame) -> DataFrame:
    """Typed rows from log text (column ``value``); other lines are dropped.

    ``kind`` is ``train`` or ``eval``; the columns of the other kind are NULL.
    """
    loss, evaluation = F.col("value").rlike(LOSS_LINE), F.col("value").rlike(EVAL_LINE)
    stamp = F.concat_ws(".", F.regexp_extract("value", TIME_PREFIX, 1),
                        F.regexp_extract("value", TIME_PREFIX, 2))
    return (
        lines.where(loss | evaluation)
        .select(
            stamp.try_cast("timestamp_ntz").alias("ts"),
            F.when(loss, "train").otherwise("eval").alias("kind"),
            F.coalesce(_part(LOSS_LINE, 1, "bigint"), _part(EVAL_LINE, 1, "bigint"))
            .alias("epoch"),
            _part(LOSS_LINE, 2, "double").alias("loss"),
            _part(LOSS_LINE, 3, "double").alias("step_seconds"),
            F.coalesce(_part(LOSS_LINE, 4, "double"), _part(EVAL_LINE, 5, "double"))
            .alias("cost_seconds"),
            _part(EVAL_LINE, 2, "double").alias("f1_macro"),
            _part(EVAL_LINE, 3, "double").alias("f1_micro"),
            _part(EVAL_LINE, 4, "double").alias("auc"),
        )
    )


def format_log_lines(epochs: DataFrame) -> DataFrame:
    """Epoch rows (ts, epoch, loss, step_seconds, total_seconds) as log text."""
    return epochs.select(F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - INFO: the "),
        F.col("epoch").cast("string"), F.lit(" epoch's resnet result:  training loss "),
        F.col("loss").cast("string"),
        F.format_string(",training per step cost %.2f s, total_cost %.2f s",
                        F.col("step_seconds").cast("double"),
                        F.col("total_seconds").cast("double")),
    ).alias("value"))


def epoch_loss(run_log: DataFrame, steps_per_epoch: int, data_size: int | None = None) -> DataFrame:
    """Mean step loss and cost of each (run, epoch); each epoch starts afresh.

    ``run_log`` has run_id, ts, step, loss.  Seconds per step are elapsed / ``data_size``, and
    the total is that times ``steps_per_epoch``.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    per_step = F.col("_elapsed") / F.lit(1e6) / F.lit(float(data_size or steps_per_epoch))
    return (
        run_log.select("run_id", epoch_of("step", steps_per_epoch).alias("epoch"), "loss",
                       seconds.alias("_us"))
        .groupBy("run_id", "epoch")
        .agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("steps"),
             (F.max("_us") - F.min("_us")).alias("_elapsed"))
        .withColumn("step_seconds", per_step)
        .withColumn("total_seconds", F.col("step_seconds") * float(steps_per_epoch))
        .drop("_elapsed")
    )


def evaluated_epochs(df: DataFrame, every: int, epoch: str = "epoch") -> DataFrame:
    """Rows of the epochs at which an evaluation runs."""
    return df.where(F.col(epoch) % every == 0)


def keep_latest(runs: DataFrame, keep: int = 2, key: str = "run_id",
                order: str = "epoch") -> DataFrame:
    """The newest ``keep`` rows of each run.

    A row_number filter: Spark cuts each map task to ``keep`` rows per run before the shuffle.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (
        runs.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= keep)
        .drop("_age")
    )


def merge_settings(config: str, args: str) -> Column:
    """Union of two maps in which ``args`` wins."""
    kept = F.map_filter(config, lambda k, _: ~F.map_contains_key(F.col(args), k))
    return F.map_concat(kept, F.col(args))


def run_manifest(runs: DataFrame, config: str = "config", args: str = "args") -> DataFrame:
    """Add ``manifest``, the merged settings of each run, and drop the two inputs."""
    return runs.withColumn("manifest", merge_settings(config, args)).drop(config, args)


def positive_slices(evaluated: DataFrame, n_classes: int) -> DataFrame:
    """For each label, the examples that carry it: how often every label is annotated and
    predicted among them, and the mean score.

    Only the positives are exploded; the class sums are columns of one hash aggregate.
    """
    sums = []
    for i in range(n_classes):
        sums += [F.sum(F.col("gt")[i]).alias(f"_g{i}"), F.sum(F.col("pred")[i]).alias(f"_p{i}"),
                 F.avg(F.col("scores")[i]).alias(f"_s{i}")]
    carried = F.filter(
        F.transform("gt", lambda g, i: F.when(g == 1, i)), lambda i: i.isNotNull())
    sliced = (
        evaluated.select("gt", "pred", "scores", F.explode(carried).alias("label_idx"))
        .groupBy("label_idx")
        .agg(F.count(F.lit(1)).alias("n_examples"), *sums)
    )
    others = F.array(*[
        F.struct(F.lit(i).alias("other_idx"), F.col(f"_g{i}").alias("n_gt"),
                 F.col(f"_p{i}").alias("n_pred"), F.col(f"_s{i}").alias("mean_score"))
        for i in range(n_classes)])
    return sliced.select("label_idx", "n_examples", F.explode(others).alias("_o")).select(
        "label_idx", "n_examples", "_o.*")
