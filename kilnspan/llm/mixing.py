"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn, repeating, and share the
    sum of all sizes by them. A target stops at `most` times its source's size, and the excess goes to the others by
    weight until none is above: target = min(most * size, weight * level), the level found by one pass
    over the sources in order of most * size / weight.
    """
    by = W.partitionBy(F.lit(0))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(by.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (at % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("top", F.col("source_size") * most).withColumn("ratio", F.col("top").cast("double") / F.col("w"))
    up = by.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("total", F.sum("source_size").over(by))
    s = s.withColumn("before", F.coalesce(F.sum("top").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("rest"))
    # in order of ratio, the first source that its level does not fill; the ones before are full
    whole = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("final", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole))
    return s.select("source", "source_size", F.least(F.col("top").cast("double"), F.col("w") * F.coalesce("final", "ratio")).alias("target"))


def uniform(key) -> F.Column:
    """52 hash bits of a key as a number in [0, 1), alike on every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def with_copies(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(own, size, source_size, target, copies): each row of docs in the struct own, so that its columns may have any names.

    A source's rate is target / size; each document is taken floor(rate) times and once more with probability
    rate - floor(rate), decided by its doc_id's hash, so reruns agree. Null texts have size 0,
    null sources are one source; a source without words has rate 0 and its documents are not taken.
    Repeated rows are decided alike. No rows give no rows.
    """
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("source").alias("key"), word_count(F.col("text")).alias("size"))
    targets = source_targets(counted.select(F.col("key").alias("source"), "size"), weights, most)
    joined = counted.join(targets, F.col("key").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(uniform(F.col("own.doc_id")) < rate - whole, 1).otherwise(0)
    return joined.select("own", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, with the columns of docs."""
    return with_copies(docs, weights, most).where("copies > 0").select("own", F.explode(F.sequence(F.lit(1), "copies"))).select("own.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    c = with_copies(docs.select("doc_id", "text", "source"))
    return c.select("own.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, source_size * 3 AS top, CAST(source_size * 3 AS DOUBLE) / w AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, first_value(CASE WHEN level <= ratio THEN level END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM l),
t AS (SELECT source, source_size, least(CAST(top AS DOUBLE), w * coalesce(fin, ratio)) AS target FROM f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
