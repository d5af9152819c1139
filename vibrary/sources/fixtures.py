"""Waveform, condition and feature tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS = 1000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sweep, sensor, i, v: a sweep for each user, with planted zeros, gaps, spikes and rails."""
    e = read(spark, sf_dir, "events")
    v = (
        F.when(F.col("user_id") % 50 == 7, F.lit(0.0))
        .when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 503 == 0, F.col("value") * 1000)
        .when(F.col("user_id") % 10 == 3, F.least("value", F.lit(60.0)))
        .otherwise(F.col("value"))
    )
    e = place_within(e.select("user_id", "event_id", "value"), "user_id", "event_id", "i")
    return e.select(F.col("user_id").alias("sweep"), F.lit("AE").alias("sensor"), F.col("i").cast("long").alias("i"), v.alias("v"))


#: Events of a stretch, about.
STRETCH = 1_000_000


def place_within(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """df with the 0-based place of each row among those of its key, by a unique whole number order. Stretches of that number are counted for each key, so a frequent key is many small windows."""
    cut = df.withColumn("_s", F.floor(F.col(order) / STRETCH))
    counts = cut.groupBy(key, "_s").agg(F.count("*").alias("_n"))
    first = counts.select(key, "_s", (F.sum("_n").over(Window.partitionBy(key).orderBy("_s")) - F.col("_n")).alias("_first"))
    cut = cut.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(order)) - 1)
    return cut.join(first, [key, "_s"]).withColumn(out, F.col("_first") + F.col("_r")).drop("_s", "_r", "_first")


def sweep_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw operating conditions of each sweep, under their telemetry names."""
    s = read(spark, sf_dir, "events").select(F.col("user_id").alias("sweep")).distinct()
    gap = F.col("sweep") % 5 == 0
    return s.select(
        "sweep",
        F.when(F.col("sweep") % 41 == 40, F.lit(float("nan"))).otherwise((1 + (F.col("sweep") * 613) % 5985).cast("double")).alias("telem_rpm_meas"),
        (33 + (F.col("sweep") * 13) % 68).cast("double").alias("telem_omron_pv_c"),
        F.when(~gap, F.lit(22.0)).alias("viscosity_40c_cst"),
        F.when(~gap, F.lit(4.1)).alias("viscosity_100c_cst"),
    )


def array_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sweep, sensor, fs, voltage (array): two sensors for each sweep."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.call_function("div", F.col("vec_id"), F.lit(2)).alias("sweep"),
        F.when(F.col("vec_id") % 2 == 0, "AE").otherwise("UL").alias("sensor"),
        F.lit(FS).alias("fs"),
        F.col("embedding").cast("array<double>").alias("voltage"),
    )


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (order), sweep (part), sensor, five features and a target."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("sweep"), F.when(F.col("l_linenumber") % 2 == 0, "AE").otherwise("UL").alias("sensor"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("collinear"),
        F.lit(1.0).alias("flat"), F.col("l_extendedprice").alias("price"),
        (0.01 * F.col("l_quantity") - 2 * F.col("l_discount") + 5 * F.col("l_tax") * F.col("l_tax") + 0.3 * (F.col("l_suppkey") % 7)).alias("target"),
    )


FEATURES = ("quantity", "discount", "tax", "collinear", "price")

#: The same tables as common table expressions.
SQL = {
    "samples": """samples AS (
  SELECT user_id AS sweep, 'AE' AS sensor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
    CASE WHEN user_id % 50 = 7 THEN 0.0 WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 503 = 0 THEN value * 1000
         WHEN user_id % 10 = 3 THEN least(value, 60.0) ELSE value END AS v
  FROM events)""",
    "meta": """meta AS (
  SELECT sweep, CASE WHEN sweep % 41 = 40 THEN CAST('NaN' AS DOUBLE) ELSE CAST(1 + (sweep * 613) % 5985 AS DOUBLE) END AS telem_rpm_meas,
    CAST(33 + (sweep * 13) % 68 AS DOUBLE) AS telem_omron_pv_c,
    CASE WHEN sweep % 5 = 0 THEN NULL ELSE 22.0::DOUBLE END AS viscosity_40c_cst, CASE WHEN sweep % 5 = 0 THEN NULL ELSE 4.1::DOUBLE END AS viscosity_100c_cst
  FROM (SELECT DISTINCT user_id AS sweep FROM events))""",
    "arrays": """arrays AS (
  SELECT vec_id // 2 AS sweep, CASE WHEN vec_id % 2 = 0 THEN 'AE' ELSE 'UL' END AS sensor, 1000.0 AS fs, CAST(embedding AS DOUBLE[]) AS voltage FROM embeddings)""",
    "features": """features AS (
  SELECT l_orderkey AS file, l_partkey AS sweep, CASE WHEN l_linenumber % 2 = 0 THEN 'AE' ELSE 'UL' END AS sensor, l_quantity AS quantity, l_discount AS discount,
    l_tax AS tax, l_quantity * 2 + l_tax AS collinear, 1.0::DOUBLE AS flat, l_extendedprice AS price,
    0.01::DOUBLE * l_quantity - 2 * l_discount + 5 * l_tax * l_tax + 0.3::DOUBLE * (l_suppkey % 7) AS target
  FROM lineitem)""",
}
