"""Rows that arrive in files, against the batch operators over all of them."""

import random

from pyspark.sql import functions as F

from kilnspan.operators import spans
from kilnspan.streaming.live import live_awake_spans, live_days

SCHEMA = "vin int, t long, v double"


def arrive(spark, tmp_path, rows, make, mode):
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    name = f"live_{mode}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_live_awake_spans_equal_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows, t = [], 1785715200
    for _ in range(240):
        t += r.choice([1, 1, 1, 20, 60, 61, 900])
        rows.append((r.randrange(2), t, float(t % 7)))
    closing = [(v, t + 50000, 0.0) for v in (0, 1)]  # moves the watermark past all spans before
    got = sorted(map(tuple, arrive(spark, tmp_path, rows + closing, live_awake_spans, "append").collect()))
    want = sorted(map(tuple, spans.awake_spans(spark.createDataFrame(rows, SCHEMA)).select("vin", "start_t", "end_t", "rows").collect()))
    assert [x for x in got if x[1] < t + 50000] == want


def test_live_days_equal_the_batch(spark, tmp_path):
    rows = [(k % 2, 1785715200 + k * 1800, float(k % 31)) for k in range(120)]
    got = arrive(spark, tmp_path, rows, lambda s: live_days(s, "v", "Europe/Berlin"), "update")
    got = got.groupBy("vin", "day", "part").agg(F.max("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).groupBy("vin", "day").agg(F.sum("rows"), F.min("low"), F.max("high"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), F.expr("timestampadd(SECOND, t, timestamp_ntz'1970-01-01')"))))
    want = df.groupBy("vin", "day").agg(F.count("*"), F.min("v"), F.max("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
