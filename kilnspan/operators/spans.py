"""Runs of rows: awake spans, sleep gaps, coverage windows and breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_time(key: str = "vin", t: str = "t"):
    return W.partitionBy(key).orderBy(t)


def with_awake(df: DataFrame, gap: int = 60, key: str = "vin", t: str = "t") -> DataFrame:
    """aw: running number of the awake span; a new one starts after a gap of more than `gap` seconds."""
    w = by_time(key, t)
    return df.withColumn("_new", (F.col(t) - F.lag(t).over(w) > gap).cast("int")).withColumn("aw", F.sum(F.coalesce("_new", F.lit(0))).over(w)).drop("_new")


def awake_spans(df: DataFrame, gap: int = 60, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, start_t, end_t, rows) of each awake span; the session window needs one shuffle and no running sum."""
    s = df.select(key, t, F.timestamp_seconds(t).alias("_ts")).groupBy(key, F.session_window("_ts", f"{gap} seconds"))
    return s.agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("rows")).drop("session_window")


def sleep_gaps(spans: DataFrame, key: str = "vin") -> DataFrame:
    """(key, from_t, to_t, seconds) between neighbouring spans."""
    w = W.partitionBy(key).orderBy("start_t")
    g = spans.withColumn("from_t", F.lag("end_t").over(w)).where("from_t is not null")
    return g.select(key, "from_t", F.col("start_t").alias("to_t"), (F.col("start_t") - F.col("from_t")).alias("seconds"))


def span_seconds(spans: DataFrame, key: str = "vin") -> DataFrame:
    return spans.groupBy(key).agg(F.sum(F.col("end_t") - F.col("start_t")).alias("seconds"), F.count("*").alias("spans"))


def coalesce_windows(windows: DataFrame, key: str = "vin") -> DataFrame:
    """Union of (key, start_t, end_t, export_id): touching windows merge and take the id of the first window that reaches the latest end."""
    order = W.partitionBy(key).orderBy("start_t", "end_t", "export_id")
    reach = F.max("end_t").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("start_t") > reach).cast("int"), F.lit(0))).over(order)
    numbered = windows.withColumn("island", island).withColumn("n", F.row_number().over(order))
    g = numbered.groupBy(key, "island")
    return g.agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t"), F.max_by("export_id", F.struct(F.col("end_t"), -F.col("n"))).alias("export_id")).drop("island")


def inside_one_window(gaps: DataFrame, windows: DataFrame, key: str = "vin") -> DataFrame:
    """The gaps (from_t, to_t) that lie in one window of their key."""
    w = windows.select(F.col(key).alias("_k"), F.col("start_t").alias("_s"), F.col("end_t").alias("_e"))
    return gaps.join(w, (F.col(key) == F.col("_k")) & (F.col("from_t") >= F.col("_s")) & (F.col("to_t") <= F.col("_e")), "left_semi")


def break_at_gaps(points: DataFrame, gap: int = 300, key: str = "vin", t: str = "t", y: str = "y") -> DataFrame:
    """A null point one second after the point before any gap of more than `gap`."""
    before = F.lag(t).over(by_time(key, t))
    p = points.select(key, t, F.col(y).cast("double").alias(y), before.alias("_b"))
    point = F.struct(F.col(t).alias("t"), F.col(y).alias("y"))
    gap_point = F.struct((F.col("_b") + 1).alias("t"), F.lit(None).cast("double").alias("y"))
    both = F.when(F.col(t) - F.col("_b") > gap, F.array(gap_point, point)).otherwise(F.array(point))
    return p.select(key, F.explode(both).alias("_p")).select(key, F.col("_p.t").alias(t), F.col("_p.y").alias(y))


def in_spans(df: DataFrame, spans: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """Rows with the span (start_t, end_t) of their key that holds them; spans are disjoint and in order, so the last one begun is the only candidate."""
    marks = spans.select(F.col(key), F.col("start_t").alias(t), F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.lit(0).alias("_kind"))
    both = df.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(t, "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("start_t", F.last("_s", True).over(w)).withColumn("end_t", F.last("_e", True).over(w))
    return both.where((F.col("_kind") == 1) & (F.col(t) <= F.col("end_t"))).drop("_kind", "_s", "_e")
