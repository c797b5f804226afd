"""Battery: standby drain, implied range, thermal spread and activity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import nth_values
from .spans import inside_one_window, sleep_gaps

PARKED, LOOK_ROWS = 6 * 3600, 600


def parked_gaps(trips: DataFrame, least: int = PARKED, key: str = "vin") -> DataFrame:
    """(key, from_t, to_t) between neighbouring trips."""
    w = W.partitionBy(key).orderBy("start_t")
    g = trips.select(key, F.lag("end_t").over(w).alias("from_t"), F.col("start_t").alias("to_t"))
    return g.where(F.col("to_t") - F.col("from_t") >= least)


def phantom_drain(df: DataFrame, sessions: DataFrame, trips: DataFrame, windows: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, from_t, to_t, hours, soc_start, soc_end, soc_lost, per_day) for parked gaps inside one window without charging.

    The levels are the last reading within LOOK_ROWS rows before and the first within as many after; gains are dropped.
    """
    s = sessions.select(F.col(key).alias("_k"), F.col("start_t").alias("_s"), F.col("end_t").alias("_e"))
    same = F.col(key) == F.col("_k")
    gaps = inside_one_window(parked_gaps(trips, key=key), windows, key)
    gaps = gaps.join(s, same & (F.col("_e") >= F.col("from_t")) & (F.col("_s") <= F.col("to_t")), "left_anti")
    # the reading's row number goes with it, so that one pass each way finds the nearest and tells how far it is
    at = F.row_number().over(W.partitionBy(key).orderBy(t))
    rows = df.select(key, F.col(t), F.col("soc").alias("_v"), at.alias("_i"))
    reading = F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))
    before, after = (F.last(reading, True).over(W.partitionBy(key).orderBy(o).rowsBetween(W.unboundedPreceding, 0)) for o in (F.asc(t), F.desc(t)))
    near = lambda c: F.when(F.abs(F.col(f"{c}._i") - F.col("_i")) <= LOOK_ROWS, F.col(f"{c}._v"))
    look = rows.select(key, F.col(t), "_i", before.alias("_b"), after.alias("_a")).select(key, F.col(t), near("_b").alias("before"), near("_a").alias("after"))
    gaps = gaps.join(look.select(key, F.col(t).alias("from_t"), F.col("before").alias("soc_start")), [key, "from_t"], "left")
    gaps = gaps.join(look.select(key, F.col(t).alias("to_t"), F.col("after").alias("soc_end")), [key, "to_t"], "left")
    out = gaps.withColumn("hours", (F.col("to_t") - F.col("from_t")) / F.lit(3600.0)).withColumn("soc_lost", F.col("soc_start") - F.col("soc_end"))
    return out.where("soc_lost >= 0").withColumn("per_day", F.col("soc_lost") / F.col("hours") * 24)


def drain_summary(events: DataFrame, spans: DataFrame, windows: DataFrame, key: str = "vin") -> DataFrame:
    """(key, events, soc_lost, hours, per_day, longest_sleep_h): pooled over phantom_drain's events; the longest gap between awake spans inside one window, 0 without any."""
    sleep = inside_one_window(sleep_gaps(spans, key), windows, key).groupBy(key).agg(F.max(F.col("seconds") / F.lit(3600.0)).alias("longest_sleep_h"))
    pooled = events.groupBy(key).agg(F.count("*").alias("events"), F.sum("soc_lost").alias("soc_lost"), F.sum("hours").alias("hours"))
    out = spans.select(key).distinct().join(pooled, key, "left").join(sleep, key, "left").fillna(0, ["events", "soc_lost", "hours", "longest_sleep_h"])
    return out.withColumn("per_day", F.when(F.col("hours") > 0, F.col("soc_lost") / F.col("hours") * 24))


def stride_sample(df: DataFrame, stride: int, part: list[str], t: str = "t") -> DataFrame:
    """Rows picked greedily in time order, each at least `stride` seconds after the one picked before, by `part`.

    A gap of `stride` resets the choice, so the pieces between such gaps are walked alone: their times stream through a
    task in order, and only the last pick is remembered.
    """
    w = W.partitionBy(*part).orderBy(t)
    cut = F.sum(F.coalesce((F.col(t) - F.lag(t).over(w) >= stride).cast("int"), F.lit(0))).over(w)
    times = df.select(*part, cut.alias("_piece"), F.col(t).cast("long").alias(t)).repartition(*part, "_piece").sortWithinPartitions(*part, "_piece", t)
    # rows of a piece are neighbours now; a number for each piece is all that the walk needs
    mark = F.xxhash64(*part, "_piece").alias("_mark")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, due = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            marks, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            picked: list[int] = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if marks[i] != piece:
                    piece, due = marks[i], at[i]
                while (i := i + int(np.searchsorted(at[i:j], due))) < j:
                    picked.append(i)
                    due = at[i] + stride
            yield b.take(pa.array(picked, pa.int64()))

    picked = times.select(mark, t, *part).mapInArrow(walk, times.select(mark, t, *part).schema).select(*part, t)
    return df.join(picked, [*part, t], "left_semi")


def implied_range(df: DataFrame, range_col: str, stride: int = 600, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, samples, p10, p50, p90) of range / charge * 100 over sampled rows with 30 to 95 % and a range."""
    rows = df.where((F.col("soc") >= 30) & (F.col("soc") <= 95) & (F.col(range_col) > 0))
    rows = stride_sample(rows.select(key, t, "soc", range_col), stride, [key], t).withColumn("_v", F.col(range_col) / F.col("soc") * 100)
    values = nth_values(rows, [key], [("_v", p / 100, f"p{p}") for p in (10, 50, 90)])
    return rows.groupBy(key).agg(F.count("*").alias("samples")).join(values, key)


def pack_thermal(df: DataFrame, hot: str, cold: str, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, hottest, coldest, spread, spread_t): the extremes apart, and the widest difference with its earliest time."""
    d = F.col(hot) - F.col(cold)
    return df.groupBy(key).agg(F.max(hot).alias("hottest"), F.min(cold).alias("coldest"), F.max(d).alias("spread"), F.max_by(t, F.when(d.isNotNull(), F.struct(d, -F.col(t)))).alias("spread_t"))


def activity_bands(trips: DataFrame, sessions: DataFrame, key: str = "vin") -> DataFrame:
    bands = trips.select(key, "start_t", "end_t", F.lit("drive").alias("kind")).unionByName(sessions.select(key, "start_t", "end_t", F.lit("charge").alias("kind")))
    return bands.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("start_t", F.desc("kind"))))
