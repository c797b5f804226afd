"""Rounding, medians, correlation and labels with the semantics that the analytics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def first_set(c: str, order: str = "t") -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def last_set(c: str, order: str = "t") -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def nth_values(df: DataFrame, keys: list[str], wanted: list[tuple[str, float, str]]) -> DataFrame:
    """(keys, names): for each (column, share, name) the value at place floor(n * share) of the group's sorted non-null values, at most the last; 0.5 gives the upper median.

    The values are ranked by a sort that spills, so a group need not fit in memory. Groups without any value are kept.
    """
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "_signal", "_v")
    group = W.partitionBy(*keys, "_signal")
    n = F.count("_v").over(group)
    place = F.sum(F.col("_v").isNotNull().cast("long")).over(group.orderBy(F.asc_nulls_last("_v")).rowsBetween(W.unboundedPreceding, 0))
    ranked = long.select(*keys, "_signal", "_v", n.alias("_n"), place.alias("_p")).where("_v is not null or _n = 0")
    at = lambda share: F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * share) + 1, F.col("_n")))
    return ranked.groupBy(*keys).agg(*[F.max(F.when((F.col("_signal") == c) & (F.col("_p") == at(share)), F.col("_v"))).alias(name) for c, share, name in wanted])


def correlation(x: str, y: str) -> Column:
    """Pearson; null below three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count(a) >= 3, r)


def mask_vin(c: Column) -> Column:
    return F.when(F.length(c) < 8, c).otherwise(F.concat(F.left(c, F.lit(4)), F.lit(" … "), F.right(c, F.lit(4))))
