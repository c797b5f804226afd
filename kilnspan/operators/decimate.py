"""Min/max ladders and windows of points for charts, and export windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTORS = tuple(4**k for k in range(1, 9))


def with_index(df: DataFrame, key: str = "vin", t: str = "t") -> DataFrame:
    return df.withColumn("idx", F.row_number().over(W.partitionBy(key).orderBy(t)) - 1)


def pyramid_level(df: DataFrame, value: str, factor: int, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, bucket, t, low, high): `factor` rows by position each, with the time of the first; null where no row has a value."""
    b = with_index(df.select(key, t, value), key, t).groupBy(key, F.floor(F.col("idx") / factor).alias("bucket"))
    return b.agg(F.min(t).alias("t"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def select_series(df: DataFrame, value: str, windows: DataFrame, pixels: int, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, x, y) for a chart of each vehicle: the rows of its window (key, from_t, to_t), or the finest level's extremes that fit the pixels.

    Each vehicle's level follows from counts of its own rows, so all are chosen in one plan.
    """
    budget = max(64, pixels)
    rows = with_index(df.select(key, t, value), key, t)
    in_window = rows.join(windows.select(key, "from_t", "to_t"), key)
    z = in_window.groupBy(key, "from_t", "to_t").agg(F.count("*").alias("_n"), F.min(F.when(F.col(t) >= F.col("from_t"), F.col("idx"))).alias("_a"), F.max(F.when(F.col(t) <= F.col("to_t"), F.col("idx"))).alias("_b"))
    z = z.where("_b >= _a").withColumn("_size", F.col("_b") + 1 - F.col("_a"))
    built = [F.when(F.col("_n") >= 2 * f, F.lit(f)) for f in FACTORS]
    fits = [F.when((F.col("_n") >= 2 * f) & (F.col("_size") / f <= budget), F.lit(f)) for f in FACTORS]
    z = z.withColumn("_f", F.when(F.col("_size") <= budget, F.lit(1)).otherwise(F.coalesce(*fits, *reversed(built), F.lit(1))))
    chosen = rows.join(z.drop("_n", "_size"), key)
    raw = chosen.where((F.col("_f") == 1) & F.col(t).between(F.col("from_t"), F.col("to_t"))).select(key, F.col(t).cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    level = chosen.where("_f > 1").groupBy(key, "_f", "_a", "_b", F.floor(F.col("idx") / F.col("_f")).alias("bucket"))
    level = level.agg(F.min(t).alias("t"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    following = F.lead("t", 1).over(W.partitionBy(key).orderBy("bucket"))
    level = level.withColumn("_next", F.coalesce(following, F.col("t") + F.col("_f")))
    level = level.where((F.col("bucket") >= F.floor(F.col("_a") / F.col("_f"))) & (F.col("bucket") < F.ceil((F.col("_b") + 1) / F.col("_f"))))
    half = F.greatest(F.lit(1.0), (F.col("_next") - F.col("t")) / 2)
    points = F.array(F.struct(F.col("t").cast("double").alias("x"), F.col("low").alias("y")), F.struct((F.col("t") + half).alias("x"), F.col("high").alias("y")))
    return raw.unionByName(level.select(key, F.explode(points).alias("p")).select(key, "p.x", "p.y"))


def export_window(df: DataFrame, signals: list[str], from_t: int | None = None, to_t: int | None = None, key: str = "vin", t: str = "t") -> DataFrame:
    """(key, time, signals) of the rows from from_t to to_t, each open if not given: ISO times in UTC and values to three decimals, halves up. The caller sorts what it writes."""
    at = F.expr(f"timestampadd(SECOND, `{t}`, timestamp_ntz'1970-01-01 00:00:00')").cast("string")
    rows = df if from_t is None else df.where(F.col(t) >= from_t)
    rows = rows if to_t is None else rows.where(F.col(t) <= to_t)
    return rows.select(key, F.concat(F.replace(at, F.lit(" "), F.lit("T")), F.lit(".000Z")).alias("time"), *[(F.floor(F.col(s) * 1000 + F.lit(0.5)) / 1000).alias(s) for s in signals])
