"""Run logs, manifests and evaluation reports on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polybag.operators.metrics import (
    BRIEF_METRICS, LABEL_METRICS, REPORT_METRICS, SCORE_METRICS)
from polybag.operators.runs import parse_run_log
from polybag.sources.batches import append_batch

# Report layout (fixed values): width of the name column, headings of the per-label lists.
NAME_WIDTH = 27
RULE = "-" * 44
LIST_HEADINGS = {
    "label_accuracy": ("label_accuracy_macro: ", "label_accuracy: "),
    "lab_precision": ("label_precious_macro: ", "lab_precision:  "),
    "lab_recall": ("label_recall_macro: ", "lab_recall:     "),
    "lab_f1": ("label_f1_macro: ", "lab_f1:         "),
}


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files to typed rows."""
    return parse_run_log(spark.read.text(path))


def append_run_log(rows: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Append a batch of step or epoch rows to the run table, once (:mod:`batches`)."""
    return append_batch(rows, path, writer, batch)


def write_manifest(manifest: DataFrame, paths: str | Sequence[str]) -> None:
    """Write the merged settings as JSON to every path."""
    for path in [paths] if isinstance(paths, str) else paths:
        manifest.write.mode("overwrite").json(path)


def manifest_frame(spark: SparkSession, config: Mapping, args: Mapping) -> DataFrame:
    """One row of settings from two dictionaries; the arguments win."""
    merged = {**config, **args}
    return spark.createDataFrame([tuple(merged.values())], list(merged))


def append_report(report: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Add one evaluation to the report table, once: ``batch`` is its epoch or number."""
    return append_batch(report, path, writer, batch)


def overwrite_report(report: DataFrame, path: str) -> None:
    """Replace the report table."""
    report.write.mode("overwrite").parquet(path)


def _pieces(layout: str) -> list[tuple[str, str | None]]:
    """(format, metric) of each line before the per-label lists; without a metric the line is fixed."""
    if layout == "score":
        return [(f"{name}:%.4f", metric) for name, metric in SCORE_METRICS.items()]
    padded = [(f"{name + ':':<{NAME_WIDTH}}%.4f", name) for name in REPORT_METRICS]
    if layout == "brief":
        return padded[:len(BRIEF_METRICS)]
    if layout == "full":
        return [(RULE, None), *padded[:-1], ("", None),
                (f"{REPORT_METRICS[-1]}: %.4f", REPORT_METRICS[-1])]
    raise ValueError(f"unknown layout: {layout}")


def report_lines(report: DataFrame, layout: str = "full") -> DataFrame:
    """The text form of a report: (line_no, line) with four decimals.

    ``full`` has all metrics and the lists of each label, ``brief`` the thirteen that need no
    scores, ``score`` the five of the short file.  ``report`` has (metric, label_idx, value): a
    few rows per label, so ordering it is cheap.
    """
    spark = report.sparkSession
    pieces = _pieces(layout)
    table = spark.createDataFrame(
        [(i, line, metric) for i, (line, metric) in enumerate(pieces)],
        "section int, form string, name string")
    overall = report.where(F.col("label_idx").isNull()).select("metric", "value")
    lines = table.where("name IS NULL").select("section", F.lit(-1).alias("row"), F.col("form").alias("line"))
    lines = lines.unionByName(table.join(F.broadcast(overall), table["name"] == overall["metric"]).select(
        "section", F.lit(-1).alias("row"), F.replace(
            "form", F.lit("%.4f"), F.format_string("%.4f", "value")).alias("line")))
    for i, metric in enumerate(LABEL_METRICS if layout == "full" else []):
        title, word = LIST_HEADINGS[metric]
        entries = report.where((F.col("metric") == metric) & F.col("label_idx").isNotNull())
        section = F.lit(len(pieces) + i).alias("section")
        # The heading rides on the first label, so a report without lists has no heading.
        heading = entries.where(F.col("label_idx") == 0).select(
            section, F.lit(-1).alias("row"), F.lit(title).alias("line"))
        lines = lines.unionByName(heading).unionByName(entries.select(
            section, F.col("label_idx").alias("row"),
            F.format_string(f"(label:%d,{word}%.4f)", "label_idx", "value").alias("line")))
    place = F.row_number().over(Window.orderBy("section", "row")) - 1
    return lines.select(place.alias("line_no"), "line")


def write_report_text(report: DataFrame, path: str, layout: str = "full",
                      batch: int | None = None) -> None:
    """Write the text form as one small file; with a ``batch``, beside those of other batches."""
    lines = report_lines(report, layout).orderBy("line_no").select(F.col("line").alias("value"))
    target = path if batch is None else f"{path.rstrip('/')}/batch={batch}"
    lines.coalesce(1).write.mode("overwrite").text(target)


def print_report(report: DataFrame) -> None:
    """Show the overall metrics on the console."""
    report.where(F.col("label_idx").isNull()).select("metric", "value").show(50, False)
