"""What the corpus operators share: tables, scratch tables in the shared folder, byte views of Arrow text."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove, write


T = TypeVar("T")
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _batch_settings(spark: SparkSession) -> dict[str, str]:
    """Settings for Arrow batches of 4 MB and 2,000 rows at most, where the session's are higher (0 or less: no bound)."""
    most = {BATCH_BYTES: 4 << 20, BATCH_ROWS: 2000}
    now = {k: int(spark.conf.get(k, str(1 << 30)).rstrip("b")) for k in most}
    return {k: str(v) for k, v in most.items() if not 0 < now[k] <= v}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for a while, whatever the texts' lengths; the session has its own settings again afterwards."""
    new = _batch_settings(spark)
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query or the pipeline. These are applications, so they set small Arrow batches for their
    session; operators given a DataFrame leave the session's settings as they are."""
    for k, v in _batch_settings(spark).items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores (one small file) dealt to all cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: this cuts the lineage, a lost
    executor costs only the tasks it ran, and later readers don't repeat the work."""
    return staged_at(df, files)[0]


def staged_at(df: DataFrame, files: int | None = None) -> tuple[DataFrame, str]:
    with small_batches(df.sparkSession):
        return write(df.coalesce(files) if files else df)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more (loops drop the tables of past rounds)."""
    remove(spark, path)


_held: list = ["", None]


def worker_cache(owner: str, make: Callable[[], T]) -> T:
    """What an operator keeps in a Python worker from batch to batch. Workers live on through other operators' tasks, so
    one operator's cache at a time is held: the next one that asks takes its place."""
    if _held[0] != owner:
        _held[1] = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # what is freed goes back to the system, where the C library can do that
            ctypes.CDLL(None).malloc_trim(0)
        _held[:] = [owner, make()]
    return _held[1]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``max_bytes`` of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_offsets(batch.column(batch.schema.get_field_index(column)), True))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(column: pa.Array, as_lengths: bool = False) -> np.ndarray:
    n = len(column)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
    return np.diff(raw).astype(np.int64) if as_lengths else raw.astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets into them. A null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    offs = _offsets(column)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each range of offsets; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact small integers for equal strings, and the distinct strings."""
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def id_fields(df: DataFrame, names: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def small_side(df: DataFrame, row_bytes: int, most_bytes: int = 16 << 20) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if its counted rows, at ``row_bytes`` each, are under ``most_bytes``;
    a larger table stays as it is, and both sides of its join are shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df
