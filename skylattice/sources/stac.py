"""STAC items that have landed as JSON, and their common form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = """id string, collection string, bbox array<double>,
 properties struct<datetime:string, `eo:cloud_cover`:double, `sat:orbit_state`:string, `sar:polarizations`:array<string>>"""
#: Start of a collection's name and the sensor.
COLLECTIONS = (("sentinel-1", "sentinel-1"), ("sentinel-2", "sentinel-2"), ("landsat", "landsat"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from files of JSON lines or whole objects; a malformed file fails."""
    return spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path)


def as_items(scenes: DataFrame) -> DataFrame:
    """Scenes in the form of items."""
    return scenes.select(
        F.col("scene_id").alias("id"), F.concat("sensor", F.lit("-c1")).alias("collection"), F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"),
        F.struct(
            F.date_format("acquired", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud").alias("eo:cloud_cover"),
            F.lit("ascending").alias("sat:orbit_state"), F.array(F.lit("VV"), F.lit("VH")).alias("sar:polarizations"),
        ).alias("properties"),
    )


def normalise(items: DataFrame) -> DataFrame:
    """Scenes of three sensors: radar has orbit and polarisations and no cloud, the others have cloud only."""
    sensor = F.lit(None).cast("string")
    for start, name in COLLECTIONS:
        sensor = F.when(F.startswith("collection", F.lit(start)), name).otherwise(sensor)
    p, radar = F.col("properties"), F.col("sensor") == "sentinel-1"
    return items.withColumn("sensor", sensor).select(
        F.col("id").alias("scene_id"), "sensor", "collection", F.try_to_timestamp(p["datetime"]).alias("acquired"), "bbox",
        F.when(~radar, p["eo:cloud_cover"]).alias("cloud"), F.when(radar, p["sat:orbit_state"]).alias("orbit_direction"),
        F.when(radar, p["sar:polarizations"]).alias("polarization"),
    )
