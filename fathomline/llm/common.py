"""Shared helpers: whole-table reads, shared-folder cuts of lineage, word splitting."""

from __future__ import annotations

import contextlib
import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the word contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: Texts of a task are worked on in groups of about this many bytes.
CHARS_A_SLICE = 2_000_000
#: While a table is written: its shuffle files go as soon as it is there, and workers get batches of a few MB.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 * CHARS_A_SLICE)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own if Spark runs on this machine alone."""
    if set_folder := spark.conf.get("spark.checkpoint.dir", None):
        return set_folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='fathomline-')}"


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathomline/{name}-{uuid.uuid4().hex}"
    with _set(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> list[Row]:
    """Rows of df; its shuffle files go as soon as they are there, as with `cut`."""
    with _set(df.sparkSession, WRITING):
        return df.select("*").collect()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    r"""Array of the words `[^\x20\x09-\x0D]+`; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


_caches: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that an operator keeps in a worker process between its tasks."""
    _caches.append({})
    return _caches[-1]


def release(keep: dict | None = None) -> None:
    """Empty what other operators keep in this worker process, so that stages don't add up."""
    for cache in _caches:
        if cache is not keep:
            cache.clear()


def slices(batch: pa.RecordBatch, column: int, size: int = CHARS_A_SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes in the given column each, at least a row."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    edges = np.flatnonzero(np.r_[True, np.diff(upto // size) > 0, True]) if len(upto) else []
    for low, high in itertools.pairwise(edges):
        yield batch.slice(low, high - low)
