"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type, repeats and loops allowed -> (node, root): every node with an edge to another one, and the smallest node it reaches.

    Each round is a few shuffles keyed by node; a round's edges never exceed twice the
    previous ones, so nothing is gathered per component. Ends after O(log^2) rounds.
    An empty table gives an empty table.
    """
    e = cut(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("o > n and m < o").select(F.col("m").alias("a"), F.col("o").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b").where("a < b").distinct()
        e, before = cut(small, "edges", 2 * seen[0]), e
        drop(before)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
