"""A library of kept recordings: Parquet folders of signals, a catalogue that is replaced by a rename, and portable backups."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable
from datetime import date

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commit import names, publish, read_line
from .registry import BYTES, SIGNALS

VERSION = 1
APP = "kilnspan"
ROW = "id string, version int, vin string, vmodel string, kept_at string, is_demo boolean, start_t long, end_t long, rows long, days long, distance_km double, trips long, stored_bytes long, columns array<string>, folder string"


class StoredFormatError(ValueError):
    """A record of another version, or an archive of another application."""


class Library:
    """Kept recordings under a folder that the driver and all executors share.

    Each state of the catalogue is a folder of its own, named by the file catalogue/N, which only one writer can make: readers see the newest state whole,
    and of two writers of the same N one fails and leaves nothing. A recording's signals lie in a folder of their own, so a replaced one stays readable until it is removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        return max(map(int, names(self.spark, f"{self.root}/catalogue")), default=0)

    def records(self) -> DataFrame:
        """All kept recordings, the oldest first; reads no signals."""
        n = self._newest()
        state = n and read_line(self.spark, f"{self.root}/catalogue/{n}")
        return (self.spark.read.schema(ROW).parquet(f"{self.root}/{state}") if n else self.spark.createDataFrame([], ROW)).orderBy("start_t", "id")

    def record(self, id: str) -> dict | None:
        found = self.records().where(F.col("id") == id).first()
        return found.asDict() if found else None

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> None:
        n, state = self._newest() + 1, f"states/{uuid.uuid4().hex}"
        change(self.records()).coalesce(1).write.parquet(f"{self.root}/{state}")
        if not publish(self.spark, f"{self.root}/catalogue/{n}", state):
            self._remove([state])
            raise RuntimeError("another writer has changed the catalogue; try again")

    def _remove(self, folders: list[str]) -> None:
        for f in folders:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)

    def _put(self, record: dict) -> bool:
        before = self.record(record["id"])
        own = self.spark.createDataFrame([record], ROW)
        self._commit(lambda r: r.where(F.col("id") != record["id"]).unionByName(own))
        self._remove([before["folder"]] if before else [])
        return before is not None

    def keep(self, id: str, signals: DataFrame, trips: int = 0, distance_km: float = 0.0, is_demo: bool = False, kept_at: str = "") -> bool:
        """Store (vin, vmodel, t, signals) of one vehicle under id; True if it replaced a recording of that id."""
        folder = f"signals/{uuid.uuid4().hex}"
        signals.repartitionByRange("t").sortWithinPartitions("t").write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        stored = self.spark.read.parquet(f"{self.root}/{folder}")
        s = stored.agg(F.max("vin").alias("vin"), F.max("vmodel").alias("vmodel"), F.count_distinct("vin").alias("vins"), F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.count_distinct(F.floor(F.col("t") / 86400)).alias("days")).first()
        if s.vins > 1:
            self._remove([folder])
            raise ValueError("a recording is of one vehicle")
        size = self._fs.getContentSummary(self._path(f"{self.root}/{folder}")).getLength()
        columns = [c for c in stored.columns if c not in ("vin", "vmodel", "t")]
        return self._put({"id": id, "version": VERSION, "vin": s.vin, "vmodel": s.vmodel, "kept_at": kept_at, "is_demo": is_demo, "start_t": s.a, "end_t": s.b, "rows": s.n, "days": s.days, "distance_km": distance_km, "trips": trips, "stored_bytes": size, "columns": columns, "folder": folder})

    def signals(self, id: str) -> DataFrame:
        """A recording's rows; only the columns that a query uses are read."""
        r = self.record(id)
        if r is None:
            raise KeyError(id)
        if r["version"] != VERSION:
            raise StoredFormatError(f"{id} was kept by version {r['version']}")
        return self.spark.read.parquet(f"{self.root}/{r['folder']}")

    def delete(self, ids: list[str]) -> None:
        gone = [r.folder for r in self.records().where(F.col("id").isin(ids)).collect()]
        self._commit(lambda r: r.where(~F.col("id").isin(ids)))
        self._remove(gone)

    def clear(self) -> None:
        gone = [r.folder for r in self.records().collect()]
        self._commit(lambda r: r.limit(0))
        self._remove(gone)

    def vehicles(self) -> DataFrame:
        """(vin, ids, is_demo, recordings, stored_bytes, bytes_if_merged): recordings by vehicle, the newest first, and the most that a merge would hold in memory."""
        r = self.records()
        width = F.aggregate("columns", F.lit(4), lambda a, c: a + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in _widths().items() for x in (k, n)]), c), F.lit(4)))
        each = r.withColumn("_held", F.col("rows") * width)
        by = each.groupBy("vin").agg(F.sort_array(F.collect_list(F.struct("end_t", "id")), asc=False).alias("_l"), F.bool_and("is_demo").alias("is_demo"), F.count("*").alias("recordings"), F.sum("stored_bytes").alias("stored_bytes"), F.sum("_held").alias("bytes_if_merged"))
        return by.orderBy(F.col("_l")[0]["end_t"].desc()).select("vin", F.col("_l.id").alias("ids"), "is_demo", "recordings", "stored_bytes", "bytes_if_merged")

    def backup(self, ids: list[str], path: str) -> None:
        """One ZIP file on the driver with the recordings' records and Parquet files, which pass through it one at a time."""
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            z.writestr("manifest.json", json.dumps({"app": APP, "format": VERSION, "ids": ids}))
            for id in ids:
                r = self.record(id)
                if r is None:
                    raise KeyError(id)
                name = f"exports/{safe_segment(id)}"
                z.writestr(f"{name}/record.json", json.dumps(r))
                parts = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/{r['folder']}").select("content")
                for k, part in enumerate(parts.toLocalIterator()):
                    z.writestr(f"{name}/{k}.parquet", bytes(part.content))

    def restore(self, path: str) -> tuple[list[str], list[str]]:
        """Keep the recordings of a backup, found by their folders: (ids kept, ids of other versions, which are skipped)."""
        kept, skipped = [], []
        with zipfile.ZipFile(path) as z:
            if not is_backup(z):
                raise StoredFormatError(f"{path} is no backup")
            for name in [n for n in z.namelist() if re.fullmatch(r"exports/[^/]+/record\.json", n)]:
                r = json.loads(z.read(name))
                if r.get("version") != VERSION:
                    skipped.append(r.get("id"))
                    continue
                folder, top = f"signals/{uuid.uuid4().hex}", name.removesuffix("record.json")
                for part in (n for n in z.namelist() if n.startswith(top) and n.endswith(".parquet")):
                    self.spark.createDataFrame(pq.read_table(io.BytesIO(z.read(part)))).write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{folder}")
                self._put(r | {"folder": folder})
                kept.append(r["id"])
        return kept, skipped


def _widths() -> dict[str, int]:
    return {k: BYTES[s.dtype] for k, s in SIGNALS.items()}


def is_backup(z: zipfile.ZipFile) -> bool:
    try:
        m = json.loads(z.read("manifest.json"))
    except (KeyError, ValueError):
        return False
    return isinstance(m, dict) and m.get("app") == APP and m.get("format") == VERSION


def safe_segment(id: str) -> str:
    """id as a file name."""
    return re.sub(r"[^A-Za-z0-9._+-]", "_", id) or "_"


def backup_name(count: int, day: date) -> str:
    """Names no vehicle; one recording goes without its count."""
    return f"{APP}-{f'{count}-' if count != 1 else ''}backup-{day.isoformat()}.zip"
