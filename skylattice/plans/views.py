"""Scenes, tiles, pixels and ledgers as views of the given tables, for Spark and, as SQL text, for the
oracle. A scene of pixels is 50 by 50; the second date mirrors the rows of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.expr("event_id div 2500").alias("scene_id"),
        F.expr("(event_id % 2500) div 50").cast("int").alias("y"),
        F.expr("event_id % 50").cast("int").alias("x"),
        (F.col("value") / (F.col("value") + 10)).cast("float").alias("p"),
        F.col("value").alias("b04"),
        (F.col("value") + F.col("user_id") % 50).alias("b08"),
        F.col("event_type").isin("error", "purchase").cast("int").alias("truth"),
        F.expr("event_id % 12").cast("int").alias("scl"),
        F.expr("event_id % 64").cast("int").alias("qa"),
    )


def px2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).withColumn("y", (SIDE - 1 - F.col("y")).cast("int"))


PX = """px AS (SELECT event_id // 2500 AS scene_id, ((event_id % 2500) // 50)::INT AS y, (event_id % 50)::INT AS x,
  (value / (value + 10))::FLOAT AS p, value AS b04, value + user_id % 50 AS b08,
  (event_type IN ('error', 'purchase'))::INT AS truth, (event_id % 12)::INT AS scl, (event_id % 64)::INT AS qa FROM events)"""
PX2 = "px2 AS (SELECT scene_id, (49 - y)::INT AS y, x, p, b04, b08, truth, scl, qa FROM px)"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), key.cast("string")).alias("scene_id"),
        key.alias("scene_no"),
        F.element_at(F.array(F.lit("sentinel-2"), F.lit("landsat"), F.lit("sentinel-1")), (key % 3 + 1).cast("int")).alias("sensor"),
        F.when(key % 17 != 0, F.col("o_orderdate")).alias("acquired"),
        F.when(key % 10 != 0, F.round(F.col("o_totalprice") % 100, 4)).alias("cloud"),
        (cust % 340 - 170).cast("double").alias("xmin"),
        (cust % 150 - 75).cast("double").alias("ymin"),
        (cust % 340 - 168).cast("double").alias("xmax"),
        (cust % 150 - 73).cast("double").alias("ymax"),
        (F.col("o_orderstatus") == "F").alias("downloaded"),
        F.col("o_orderpriority").alias("region"),
    )


SCENES = """scenes AS (SELECT 'S' || o_orderkey AS scene_id, o_orderkey AS scene_no,
  ['sentinel-2', 'landsat', 'sentinel-1'][(o_orderkey % 3 + 1)::INT] AS sensor,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS acquired,
  CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice % 100, 4) END AS cloud,
  (o_custkey % 340 - 170)::DOUBLE AS xmin, (o_custkey % 150 - 75)::DOUBLE AS ymin,
  (o_custkey % 340 - 168)::DOUBLE AS xmax, (o_custkey % 150 - 73)::DOUBLE AS ymax,
  o_orderstatus = 'F' AS downloaded, o_orderpriority AS region FROM orders)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with vectors: the scenes whose number is that of a vector."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"), F.col("label"))
    return vectors.join(scenes(spark, sf_dir), F.col("vec_id") == F.col("scene_no")).select(
        F.concat(F.lit("T"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("tile_id"), "vec_id", "vector", "label",
        "scene_id", "sensor", "acquired", "cloud", "xmin", "ymin", "xmax", "ymax", "region",
    )


TILES = f"""{SCENES}, tiles AS (SELECT 'T' || lpad(vec_id::VARCHAR, 8, '0') AS tile_id, vec_id, embedding AS vector, label,
  scene_id, sensor, acquired, cloud, xmin, ymin, xmax, ymax, region FROM embeddings JOIN scenes ON vec_id = scene_no)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events: one ledger for each user, in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("ledger_id"), F.row_number().over(order).cast("long").alias("seq"), "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.upper("event_type").alias("action"), F.col("props").alias("detail"),
    )


LEDGER = """ledger AS (SELECT user_id AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS stamp, upper(event_type) AS action, props AS detail FROM events)"""
