"""Keep the newest outputs of each run and remove the rest, for real.

Below ``root`` lies a folder per run, in it a folder per output, such as ``run=a/epoch=7``.  The
number at the end of an output's name orders it; outputs without one are older than all that have
one and go by their time.  An output that is held (see ``hold``) stays until its lease runs out,
and does not count against ``keep``.  Only names and times pass through the driver, one run's at
a time; all leases of a run are found in one call.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import batched

from pyspark.sql import SparkSession

from polybag.sources import folders

LEASE = "_LEASE"
HOUR = 3600.0
AT_ONCE = 1000
_NUMBER = re.compile(r"(\d+)$")


def hold(spark: SparkSession, folder: str) -> None:
    """Begin or renew a lease: whoever reads or writes the folder calls this within its time."""
    folders.write_text(spark, f"{folder.rstrip('/')}/{LEASE}")


def release(spark: SparkSession, folder: str) -> None:
    """End a lease before its time."""
    lease = f"{folder.rstrip('/')}/{LEASE}"
    if folders.exists(spark, lease):
        folders.remove(spark, lease)


def is_held(spark: SparkSession, folder: str, lease_seconds: float, now: float | None = None) -> bool:
    """Whether the folder's lease was renewed in the last ``lease_seconds``."""
    now = time.time() if now is None else now
    return any(e.name == LEASE and e.modified_ms / 1000 > now - lease_seconds
               for e in folders.entries(spark, folder))


def _age(output: folders.Entry) -> tuple:
    number = _NUMBER.search(output.name)
    return (1, int(number[1])) if number else (0, output.modified_ms)


def expired(spark: SparkSession, root: str, keep: int, lease_seconds: float = HOUR,
            now: float | None = None) -> Iterator[str]:
    """The outputs that ``expire_outputs`` would remove, run by run."""
    if keep < 0:
        raise ValueError("keep is a number of outputs")
    for run in folders.entries(spark, root):
        if not run.is_folder or run.name.startswith(("_", ".")):
            continue
        outputs = [o for o in folders.entries(spark, run.path)
                   if o.is_folder and not o.name.startswith(("_", "."))]
        since = (time.time() if now is None else now) - lease_seconds
        held_now = {os.path.dirname(lease.path) for lease in folders.grandchildren(spark, run.path, LEASE)
                    if lease.modified_ms / 1000 > since}
        free = [o for o in sorted(outputs, key=_age) if o.path not in held_now]
        yield from (o.path for o in free[:len(free) - keep] if keep < len(free))


def expire_outputs(spark: SparkSession, root: str, keep: int = 2, lease_seconds: float = HOUR,
                   now: float | None = None) -> list[str]:
    """Remove all but the newest ``keep`` outputs of each run; the removed folders."""
    gone = []
    for paths in batched(expired(spark, root, keep, lease_seconds, now), AT_ONCE):
        folders.remove_all(spark, paths)
        gone += paths
    return gone


@contextmanager
def held(spark: SparkSession, folder: str) -> Iterator[str]:
    """Hold a folder for the time of a block."""
    hold(spark, folder)
    try:
        yield folder
    finally:
        release(spark, folder)
