"""Tables written on the way: computed once, with their lineage ended, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Folders of cut() that are there still.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; a temporary one only in local mode without that setting."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="kilnspan-")
    return f"file://{_own_dir}"


#: Rows of numbers that a file should have at least, where all cores have work, and at most.
FEW_ROWS, MANY_ROWS = 20_000, 1_000_000


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage ended, safe when executors are lost.

    rows: about how many there are at most, of tables of a few numbers a row: a small table is then written by as few tasks as it needs, not as a small file by each partition.
    """
    spark = df.sparkSession
    if rows is not None:
        few, many = -(-rows // FEW_ROWS), -(-rows // MANY_ROWS)
        df = df.coalesce(max(1, many, min(few, spark.sparkContext.defaultParallelism)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    _written.append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the folders of tables that cut() returned, once all that reads them is written."""
    for df in tables:
        _delete(df.sparkSession, df._folder)


def sweep(spark: SparkSession, keep: tuple[DataFrame, ...] = (), mark: int = 0) -> None:
    """Delete all folders that cut() has written (after the first `mark` of them) but those of `keep`.

    Operators return lazily, so the tables that their results read stay until a caller who has written the result sweeps them.
    """
    for path in _written[mark:]:
        if path not in [df._folder for df in keep]:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def cut_and_sweep(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut() of what make returns, without the folders that make has cut on the way: the result no longer reads them. Not for several threads of a driver at once."""
    mark = len(_written)
    out = cut(make(), name)
    sweep(out.sparkSession, (out,), mark)
    return out
