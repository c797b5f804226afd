"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, cut_and_sweep, drop, shared_dir, sweep

__all__ = ["cut", "cut_and_sweep", "drop", "shared_dir", "sweep"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts in an Arrow batch.
TEXTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that returns unused memory to the system when a task ends: Python workers live on, and what they keep adds to the executor's."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return trimmed


def small_batches(spark: SparkSession) -> None:
    """From now on the session passes at most TEXTS rows at once to Python. Texts are long, and results come back lazily, so the setting has to outlast the call."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXTS:
        spark.conf.set(BATCH_ROWS, str(TEXTS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """64 bits that stand for a row's id and text, nulls included."""
    marked = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.xxhash64(*marked, *[c.isNull() for c in cols])
