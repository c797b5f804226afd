"""Kept recordings: upserts, order, deletion and backups."""

import json
import zipfile
from dataclasses import replace
from datetime import date

import pytest

from kilnspan.sources import registry
from kilnspan.sources.commit import names, publish, read_line
from kilnspan.sources.library import Library, StoredFormatError, backup_name, safe_segment


def signals(spark, vin, t, v):
    return spark.createDataFrame([(vin, "m", x, v) for x in t], "vin string, vmodel string, t long, esp_vehspd double")


def test_library(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.records().collect() == [] and lib.record("a") is None
    assert not lib.keep("b", signals(spark, "L1", range(500, 510), 1.0))
    assert not lib.keep("a", signals(spark, "L1", range(100, 120), 2.0), trips=3, is_demo=True)
    assert not lib.keep("c/1", signals(spark, "L2", range(5), 3.0))
    assert [r.id for r in lib.records().collect()] == ["c/1", "a", "b"]
    assert lib.keep("a", signals(spark, "L1", range(100, 103), 4.0).withColumnRenamed("esp_vehspd", "other"))
    assert lib.record("a")["columns"] == ["other"] and lib.signals("a").count() == 3
    by = {r.vin: r for r in lib.vehicles().collect()}
    assert by["L1"].ids == ["b", "a"] and by["L1"].bytes_if_merged == 10 * 5 + 3 * 8 and not by["L1"].is_demo
    with pytest.raises(ValueError):
        lib.keep("x", signals(spark, "L1", [1], 0.0).union(signals(spark, "L2", [2], 0.0)))
    lib.backup(["a", "c/1"], str(tmp_path / "z.zip"))
    lib.delete(["a"])
    assert [r.id for r in lib.records().collect()] == ["c/1", "b"]
    other = Library(spark, f"file://{tmp_path}/other")
    assert other.restore(str(tmp_path / "z.zip")) == (["a", "c/1"], [])
    assert sorted(r.t for r in other.signals("a").collect()) == [100, 101, 102] and other.signals("c/1").first().esp_vehspd == 3.0
    lib.clear()
    assert lib.records().count() == 0
    with pytest.raises(KeyError):
        lib.signals("b")


def test_other_archives(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.csv", "x")
    with pytest.raises(StoredFormatError):
        lib.restore(str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"app": "kilnspan", "format": 1}))
        z.writestr("exports/q/record.json", json.dumps({"id": "q", "version": 99}))
    assert lib.restore(str(tmp_path / "y.zip")) == ([], ["q"])
    assert backup_name(3, date(2026, 9, 4)) == "kilnspan-3-backup-2026-09-04.zip" and backup_name(1, date(2026, 9, 4)) == "kilnspan-backup-2026-09-04.zip"
    assert safe_segment("DA+DB/..") == "DA+DB_.."


def test_of_two_writers_one_fails_and_leaves_nothing(spark, tmp_path, monkeypatch):
    a, b = (Library(spark, f"file://{tmp_path}/lib") for _ in range(2))
    a.keep("one", signals(spark, "L1", range(5), 1.0))
    stale = b._newest()
    a.keep("two", signals(spark, "L1", range(5), 1.0))
    monkeypatch.setattr(b, "_newest", lambda: stale)
    with pytest.raises(RuntimeError):
        b.delete(["one"])
    assert [r.id for r in a.records().collect()] == ["one", "two"] and a.signals("one").count() == 5


def test_publish_makes_a_file_once(spark, tmp_path):
    path = f"file://{tmp_path}/deep/name"
    assert names(spark, f"file://{tmp_path}/deep") == []
    assert publish(spark, path, "first") and not publish(spark, path, "second")
    assert read_line(spark, path) == "first" and names(spark, f"file://{tmp_path}/deep") == ["name"]


def test_a_stored_column_keeps_its_rules():
    now = registry.SIGNALS["esp_vehspd"]
    assert registry.spec_to_use(replace(now, unit="old")) is now
    other = replace(now, scale=2.0)
    assert registry.spec_to_use(other) is other and registry.spec_to_use(replace(now, key="gone")).key == "gone"
