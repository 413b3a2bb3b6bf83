"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of this machine stands in only where the setting is empty and all tasks run on this machine, as in local
    tests; elsewhere an empty setting is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return folder.rstrip("/")


_OPEN: list[list[str]] = []


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Folders that new_dir() names within are deleted at the end: what reads them must have been written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again: this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}" if folder else new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Memo:
    """Values by key, of bounded number: those used last, at least half of `most`."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def get_all(self, keys: list) -> list:
        """The values, None where there is none."""
        if 2 * len(self.now) > self.most:
            self.now, self.before = {}, self.now
        found = list(map(self.now.get, keys))
        if self.before:
            for i, v in enumerate(found):
                if v is None and (v := self.before.get(keys[i])) is not None:
                    found[i] = self.now[keys[i]] = v
        return found


def trimmed(run):
    """run, after which a worker gives freed memory back to the system: workers live on between tasks and stages."""

    def kept_small(batches):
        yield from run(batches)
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return kept_small


def texts(column: pa.Array) -> pa.Array:
    """A string column with empty strings for nulls."""
    return pc.fill_null(column, "") if column.null_count else column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def slices(column: pa.Array, max_bytes: int):
    """(first, last) row ranges of about max_bytes of text each; a longer row stands alone."""
    import numpy as np

    if not len(column):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    first, n, base = 0, len(sizes), 0
    while first < n:
        last = int(np.searchsorted(ends, base + max_bytes, side="right"))
        last = min(n, max(last, first + 1))
        yield first, last
        base, first = int(ends[last - 1]), last
