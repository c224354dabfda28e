"""Samples by id: a table laid out so that a sample is one small read, and a source that knows it.

``write_samples`` deals rows to files by a checksum of their id and sorts each file by id.
``SampleSource`` is a Python data source over that layout: a filter on the id is pushed down, the
plan gets one partition per file that can hold one of the ids, and a task reads only the row
groups of its file whose range of ids fits.  Without such a filter every file is read.

Ids are of any type with a text form that tells them apart; null ids are kept and never match.
Repeated ids are all found.  Files are read through Arrow, from any store it knows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition)
from pyspark.sql.types import StructType

from polybag.session import ship_package
from polybag.sources import folders

NAME = "polybag_samples"
LAYOUT = "_layout.json"
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"
ROW_GROUP_BYTES = 1 << 20


def bucket_of(key: Any, buckets: int) -> int:
    return zlib.crc32(str(key).encode()) % buckets


def write_samples(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``rows`` for access by ``key``; one shuffle, ``buckets`` files."""
    if "bucket" in rows.columns:
        raise ValueError("a column named bucket would hide that of the layout")
    bucket = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % buckets
    (rows.withColumn("bucket", bucket.cast("int")).repartition(buckets, "bucket")
     .sortWithinPartitions("bucket", key)
     .write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("bucket").parquet(path))
    folders.write_text(rows.sparkSession, f"{path.rstrip('/')}/{LAYOUT}", json.dumps(
        {"key": key, "buckets": buckets, "schema": rows.schema.json()}))


def open_store(path: str):
    """(file system, path in it) of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Bucket(InputPartition):
    """One file, and the ids wanted from it (None: all)."""

    def __init__(self, number: int, ids: tuple | None) -> None:
        super().__init__(number)
        self.number, self.ids = number, ids


class SampleReader(DataSourceReader):
    def __init__(self, path: str, layout: dict, schema: StructType) -> None:
        self.path, self.layout, self.schema = path, layout, schema
        self.ids: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the id; returns the others, which Spark applies itself."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.layout["key"],):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                wanted.discard(None)
                self.ids = wanted if self.ids is None else self.ids & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        buckets = self.layout["buckets"]
        if self.ids is None:
            return [Bucket(i, None) for i in range(buckets)]
        by_bucket: dict[int, list] = {}
        for i in sorted(self.ids, key=str):
            by_bucket.setdefault(bucket_of(i, buckets), []).append(i)
        # A plan needs a partition, also where nothing can match.
        return [Bucket(b, tuple(ids)) for b, ids in sorted(by_bucket.items())] or [Bucket(0, ())]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = open_store(self.path)
        folder = fs.FileSelector(f"{base}/bucket={partition.number}", allow_not_found=True)
        files = [f.path for f in store.get_file_info(folder) if f.path.endswith(".parquet")]
        if not files or partition.ids == ():
            return
        target = to_arrow_schema(self.schema)
        data = ds.dataset(files, filesystem=store, format="parquet")
        wanted = None if partition.ids is None else ds.field(self.layout["key"]).isin(list(partition.ids))
        for batch in data.to_batches(columns=target.names, filter=wanted):
            if batch.num_rows:
                yield batch.cast(target)


class SampleSource(DataSource):
    """Format ``polybag_samples``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _layout(self) -> dict:
        store, base = open_store(self.options["path"].rstrip("/"))
        with store.open_input_stream(f"{base}/{LAYOUT}") as file:
            return json.loads(file.read())

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._layout()["schema"]))

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(self.options["path"].rstrip("/"), self._layout(), schema)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The table; a filter on its id reads only the files that may hold it.

    Registers the source and lets Spark push filters to Python sources (a session setting).
    """
    ship_package(spark)
    spark.dataSource.register(SampleSource)
    spark.conf.set(PUSH_DOWN, "true")
    return spark.read.format(NAME).option("path", path).load()


def fetch_samples(spark: SparkSession, path: str, key: str, ids: Sequence) -> DataFrame:
    """The samples of these ids."""
    rows = read_samples(spark, path)
    return rows.where(F.col(key).isin(list(ids))) if ids else rows.where(F.lit(False))
