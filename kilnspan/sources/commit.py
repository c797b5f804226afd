"""Files that are there whole or not at all, and that only one of several writers makes."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, line: str) -> bool:
    """Make the file path with this line; False if it is there already. The file is written whole under another name first and gets its own in one step that fails if it is taken."""
    at, fs = _file_system(spark, path)
    fs.mkdirs(at.getParent())
    made = at.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(made, False)
    out.write(bytearray(f"{line}\n".encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename within a machine replaces; a link does not
            local = [urlparse(x.toUri().toString()).path for x in (made, at)]
            os.link(*local)
            return True
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        none = gateway.new_array(rename, 1)
        none[0] = rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, at, none)
        return True
    except FileExistsError:
        return False
    except Exception:  # py4j wraps FileAlreadyExistsException; anything else is a failure
        if fs.exists(at) and read_line(spark, path) == line:
            return True
        if fs.exists(at):
            return False
        raise
    finally:
        fs.delete(made, False)


def read_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that is not blank, read by the driver; empty if there is none."""
    at, fs = _file_system(spark, path)
    io = spark.sparkContext._jvm.java.io
    reader = io.BufferedReader(io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            if line.strip():
                return line
        return ""
    finally:
        reader.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published files of a folder; none if there is no such folder."""
    at, fs = _file_system(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [n for n in found if not n.endswith(".tmp") and not n.startswith(".")]


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)
