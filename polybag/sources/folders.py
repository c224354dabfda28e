"""Folders in whatever file system Spark writes to: list, commit marks, age, removal.

A call to the JVM takes longer than a look at a local folder.  So what lies in the machine's own file
system is listed and removed from here, and elsewhere a path costs as few calls as it can.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import SparkSession

# The file Spark's writers leave when all of a job's output is in place.
COMMITTED = "_SUCCESS"
# Hadoop keeps one of these beside each local file and lists none.
_CHECKSUM = re.compile(r"\..*\.crc", re.DOTALL)


class Entry(NamedTuple):
    name: str
    path: str
    is_folder: bool
    modified_ms: int


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What lies directly in a folder; none if there is no such folder."""
    files, target = _place(spark, path)
    if not files.exists(target):
        return []
    here = files.makeQualified(target).toUri().getPath() if _is_local(files) else ""
    if os.path.isdir(here):
        with os.scandir(here) as found:
            return sorted(e for e in map(_local_entry, found) if e and not _CHECKSUM.fullmatch(e.name))
    return sorted(map(_entry, files.listStatus(target)))


def _is_local(files) -> bool:
    return files.getUri().getScheme() == "file"


def _local_entry(found: os.DirEntry) -> Entry | None:
    try:
        return Entry(found.name, f"file:{found.path}", found.is_dir(), found.stat().st_mtime_ns // 1_000_000)
    except FileNotFoundError:  # it has gone in the meantime
        return None


def _entry(status) -> Entry:
    path = status.getPath().toString()
    return Entry(path.rpartition("/")[2], path, status.isDirectory(), status.getModificationTime())


def grandchildren(spark: SparkSession, path: str, name: str) -> list[Entry]:
    """The entries of that name in the folders that lie in a folder, found in one call."""
    exact = re.sub(r"([][{}*?\\])", r"\\\1", path.rstrip("/"))
    files, pattern = _place(spark, f"{exact}/*/{name}")
    return sorted(map(_entry, files.globStatus(pattern) or []))


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote this folder came to its end."""
    return exists(spark, f"{path.rstrip('/')}/{COMMITTED}")


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder with all it holds."""
    files, target = _place(spark, path)
    return files.delete(target, True)


def remove_all(spark: SparkSession, paths: Sequence[str]) -> None:
    """Remove folders of one file system."""
    if not paths:
        return
    files, _ = _place(spark, paths[0])
    place, local = spark._jvm.org.apache.hadoop.fs.Path, _is_local(files)
    for path in paths:
        here = re.sub("^file:(//)?(?=/)", "", path) if local else ""
        if local:
            shutil.rmtree(here, ignore_errors=True)
        if not local or os.path.lexists(here):
            files.delete(place(path), True)


def write_text(spark: SparkSession, path: str, text: str = "") -> None:
    """Write one small file, in place of an earlier one; its time of modification becomes now."""
    files, target = _place(spark, path)
    out = files.create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
