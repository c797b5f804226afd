"""The driver's tables as telemetry: ev (events), tel (dense pseudo-telemetry made from lineitem), hab (tel with habits) and tel as the files of an export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch
from ..scratch import shared_dir

#: Valid in Spark and in other SQL engines alike; {lineitem} is the table.
TEL = """
WITH n AS (SELECT l_suppkey % 4 AS vin, l_quantity q, l_discount d, l_linenumber ln,
    row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,
      l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus) - 1 AS n FROM {lineitem}),
p AS (SELECT *, CAST(floor(n/2000) AS BIGINT) AS blk, n % 2000 AS ph FROM n)
SELECT vin, 1704067200 + n + 1800*blk + 21600*CAST(floor(n/6000) AS BIGINT) AS t,
  CASE WHEN ph BETWEEN 300 AND 1499 THEN 1 ELSE 4 END AS gear,
  CASE WHEN q = 50 THEN NULL WHEN ph BETWEEN 700 AND 760 THEN 0
       WHEN ph BETWEEN 300 AND 1499 THEN CAST(q AS INT)+20 ELSE 0 END AS speed,
  1000 + 12*blk + LEAST(12, GREATEST(0, CAST(floor((ph-300)/100) AS BIGINT))) AS odo,
  90 - CAST(floor(n/500) AS BIGINT) % 60 AS soc, 400 AS volt,
  CASE WHEN ph BETWEEN 300 AND 1499 THEN CAST(round(d*1000) AS INT) - 30 ELSE 0 END AS curr,
  CASE WHEN blk % 3 = 2 AND ph >= 1600 THEN 11 ELSE 0 END AS chrg,
  CASE WHEN ph BETWEEN 280 AND 290 THEN 1 ELSE 0 END AS door, 1000 + 11*ln AS tyre_raw FROM p
"""


#: tel with charging to 80 % at the end of two blocks of three, none before the long pauses, and days of rest after every fifth block; {tel} is the table.
HAB = """
WITH r AS (SELECT *, CAST(floor((odo - 1000) / 12) AS BIGINT) AS b, row_number() OVER (PARTITION BY vin, odo ORDER BY t) AS rn FROM {tel}),
c AS (SELECT *, b > 0 AND (odo - 1000) % 12 = 0 AND rn BETWEEN 101 AND 500 AND b % 3 <> 0 AS charging FROM r)
SELECT vin, t + 200000 * CAST(floor(b / 5) AS BIGINT) AS t, gear, speed, odo, CASE WHEN charging THEN 60 + CAST(floor((rn - 100) / 20) AS BIGINT) ELSE soc END AS soc,
  volt, curr, CASE WHEN charging THEN 11 ELSE 0 END AS chrg, door, tyre_raw FROM c
"""


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vin, t, kind, value): vin is the user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("vin"), epoch("ts").alias("t"), F.col("event_type").alias("kind"), "value")


def hab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HAB, tel=tel(spark, sf_dir))


#: Signals of an export's streams, as expressions over tel; the motor's torque is never there.
EXPORT = {
    "operation": {"esp_vehspd": "speed", "esp_vehlongaccel": "curr * 0.002768", "cdcu_totalodometer": "odo", "ldcu_currentgearlev": "gear"},
    "power_energy": {"bms_battvolt": "volt", "bms_battcurr": "curr", "ldcu_chrgpwr": "chrg", "ldcu_bms_soc_disp": "soc", "ipuf_acttorq": "CAST(NULL AS DOUBLE)"},
    "status": {"ldcu_driverdoorajarst": "door", "ldcu_tpmsprfl": "tyre_raw * 0.25"},
}


def as_export(df: DataFrame) -> list[str]:
    """tel as CSV files with the names and columns of an export, in the shared folder; their paths. A stream lacks some seconds, and some come twice."""
    spark, top = df.sparkSession, f"{shared_dir(df.sparkSession)}/export-{uuid.uuid4().hex}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for k, (stream, signals) in enumerate(EXPORT.items()):
        rows = df.where(F.col("t") % 7 != k)
        rows = rows.unionByName(rows.where(F.col("t") % 50 == k + 10))
        named = rows.select(F.col("vin").cast("string").alias("vin"), F.lit("M").alias("vmodel"), F.col("t").cast("string").alias("timer"), F.lit("x").alias("ds"), *[F.expr(e).cast("double").alias(n) for n, e in signals.items()])
        named.write.option("header", True).csv(f"{top}/{stream}")
        parts = sorted(s.getPath().getName() for s in fs.listStatus(fs_path(f"{top}/{stream}")) if s.getPath().getName().startswith("part-"))
        for n, part in enumerate(parts):
            path = f"{top}/DA1_dwd_opp_gdpr_veh_driving_{stream}_di{f'_part{n}' if n else ''}.csv"
            fs.rename(fs_path(f"{top}/{stream}/{part}"), fs_path(path))
            out.append(path)
    return out
