"""A store of counts that grows by runs: each batch adds one, compaction folds old ones.

The running state of an evaluation is a table of counts per (label, score, ...), as long as there
are distinct scores.  Kept in a streaming aggregate, all of it would be state, and complete mode
would emit all of it after every batch.  Here a batch only writes its own counts, as a run of
sorted files below ``path``; whoever wants the totals adds the runs up.

* A run is named after the first and last batch it holds and counts from the moment its commit
  mark is there.  A run inside the span of a larger committed one is dead.  So the folder itself
  says what is live; there is no list to keep in step with it.
* A batch that is repeated overwrites its own run, or is dead on arrival.
* When ``fan`` live runs of a level stand side by side, they are written as one run of the next
  level.  A row is thus rewritten at most log_fan(batches) times.  What a compaction replaced is
  removed by the next one, so that a reader that listed it before has time to finish.

Rows of a file are sorted by the keys, and a folded run is range-partitioned by them, so that its
files cover narrow spans of scores: a filter on them skips files, and equal neighbours compress.  The
run of a batch stays in the partitions it was counted in; its rows move once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polybag.sources import folders

FAN = 8
_NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)")


class Run(NamedTuple):
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first:012d}-{self.last:012d}"

    def covers(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


class CountStore:
    """Sums of the columns other than ``keys``, per ``keys``, over all batches added.

    ``schema`` is that of a batch's counts.  One writer at a time; any number of readers.
    """

    def __init__(self, path: str, schema: StructType, keys: Sequence[str], fan: int = FAN) -> None:
        if fan < 2:
            raise ValueError("a compaction needs at least two runs")
        self.path, self.schema, self.keys, self.fan = path.rstrip("/"), schema, list(keys), fan
        self.sums = [f.name for f in schema if f.name not in self.keys]

    def _committed(self, spark: SparkSession) -> list[Run]:
        found = []
        for entry in folders.entries(spark, self.path):
            match = _NAME.fullmatch(entry.name)
            if match and folders.committed(spark, entry.path):
                found.append(Run(*map(int, match.groups())))
        return found

    def runs(self, spark: SparkSession) -> list[Run]:
        """The live runs, oldest first."""
        found = self._committed(spark)
        return sorted((r for r in found if not any(o.covers(r) for o in found)), key=lambda r: r.first)

    def _added(self, rows: DataFrame) -> DataFrame:
        typed = {f.name: f.dataType for f in self.schema}
        return rows.groupBy(*self.keys).agg(*(F.sum(c).cast(typed[c]).alias(c) for c in self.sums))

    def _read(self, spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/{r.name}" for r in runs))

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{self.path}/{run.name}")

    def append(self, counts: DataFrame, batch: int) -> None:
        """Add the counts of a batch, once however often it is repeated, and compact if due."""
        spark = counts.sparkSession
        run = Run(0, batch, batch)
        if not any(r.covers(run) for r in self._committed(spark)):
            self._write(counts.select(*self.schema.names), run)
        self.compact(spark)

    def compact(self, spark: SparkSession) -> int:
        """Fold the oldest ``fan`` neighbours of equal level until there are no more; how often."""
        folds = 0
        while True:
            due, live = [], self.runs(spark)
            for run in live:
                due = [*due, run] if due and due[-1].level == run.level else [run]
                if len(due) == self.fan:
                    break
            else:
                return folds
            if not folds:
                self._remove_dead(spark)
            # Rows of a key meet in their range, so the sums need no move of their own.
            ranged = self._read(spark, due).repartitionByRange(*self.keys)
            self._write(self._added(ranged), Run(due[0].level + 1, due[0].first, due[-1].last))
            folds += 1

    def _remove_dead(self, spark: SparkSession) -> None:
        found = self._committed(spark)
        for run in found:
            if any(o.covers(run) for o in found):
                folders.remove(spark, f"{self.path}/{run.name}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The counts of all live runs, a key as often as there are runs that have it."""
        return self._read(spark, self.runs(spark))

    def total(self, spark: SparkSession) -> DataFrame:
        """The sums over all batches added so far; of the schema, and empty before the first."""
        return self._added(self.rows(spark))
