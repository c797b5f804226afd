"""Tables written on the way."""

import os

from kilnspan import scratch


def folders(df):
    return df._folder.removeprefix("file://")


def test_cut_drop_and_sweep(spark):
    a = scratch.cut(spark.range(100).repartition(8), "a", 100)
    b = scratch.cut(spark.range(5).selectExpr("id", "id as B"), "b")
    assert a.count() == 100 and sum(f.endswith(".parquet") for f in os.listdir(folders(a))) == 1
    assert b.columns == ["id", "B"] and all(map(os.path.isdir, map(folders, (a, b))))
    scratch.drop(a)
    assert not os.path.exists(folders(a))
    kept = scratch.cut_and_sweep(lambda: scratch.cut(spark.range(7), "inner").where("id > 2"), "outer")
    assert kept.count() == 4 and not [f for f in os.listdir(os.path.dirname(folders(kept))) if f.startswith("inner-")]
    scratch.sweep(spark, (kept,))
    assert not os.path.exists(folders(b)) and kept.count() == 4


def test_an_empty_table(spark):
    assert scratch.cut(spark.range(0), "none", 0).count() == 0
