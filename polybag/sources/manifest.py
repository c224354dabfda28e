"""A catalogue of image files that is kept, listed by the executors and extended folder by folder.

Folders come as a table.  Each is listed by a task of its own choice of folders, so one driver
neither lists nor holds the files.  The listing is appended to the manifest, once per batch
(:mod:`polybag.sources.batches`); a later call lists only the folders that are not in it.

A folder without files is in the manifest too, with a null path, or it would be listed again and
again; so is one that does not exist.  Repeated and null folders are left out.  A folder that has
changed since is not looked at: take its batch back, or list it under another name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.session import map_arrow, saved
from polybag.sources import folders as store
from polybag.sources.batches import append_batch, read_batches
from polybag.sources.samples import open_store

FILES = "folder string, sid string, path string, length bigint, modified_ms bigint"
WRITER = "listing"
# Folders a task lists, at most, while there are enough tasks.
PER_TASK = 64


def child_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder): what lies directly below ``root``, one per entity; only names pass the driver."""
    found = [(e.path,) for e in store.entries(spark, root) if e.is_folder and e.name[0] not in "._"]
    return spark.createDataFrame(found, "folder string")


def _lister(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [c.split()[0] for c in FILES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, base = open_store(folder)
                found = [f for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True))
                         if f.is_file and fnmatch(f.base_name, pattern)]
                prefix, sid = folder.rstrip("/"), folder.rstrip("/").rsplit("/", 1)[-1]
                rows = [(folder, sid, f"{prefix}/{f.base_name}", f.size, f.mtime_ns // 1_000_000) for f in found]
                rows = rows or [(folder, sid, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def list_files(folders: DataFrame, pattern: str = "*.jpg") -> DataFrame:
    """(folder, sid, path, length, modified_ms) of the files in each folder, listed by executors."""
    wanted = folders.select("folder").where("folder IS NOT NULL").distinct()
    tasks = max(1, -(-wanted.count() // PER_TASK))
    return map_arrow(wanted.repartition(tasks, "folder"), _lister(pattern), FILES)


def extend_manifest(folders: DataFrame, path: str, batch: int, pattern: str = "*.jpg") -> int:
    """List the folders that the manifest does not have; how many those were.

    ``batch`` numbers the call: a call that is repeated adds nothing.
    """
    spark = folders.sparkSession
    known = read_batches(spark, path, FILES).select("folder").distinct()
    new = saved(folders.select("folder").where("folder IS NOT NULL").distinct().join(known, "folder", "left_anti"),
                "folders")
    append_batch(list_files(new, pattern), path, WRITER, batch)
    return new.count()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sid, path, length) of all files listed so far: the catalogue the bag operators take."""
    return read_batches(spark, path, FILES).where("path IS NOT NULL").select("sid", "path", "length")


def folder_counts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, batch, files): which call listed a folder, and what it found."""
    return read_batches(spark, path, FILES).groupBy("folder", "batch").agg(F.count("path").alias("files"))
