"""Map layers from tagged elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAJOR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary")


def classify(elements: DataFrame) -> DataFrame:
    """One row for each layer of an element (``tags``, ``closed``). Closed water is a line and an area."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    closed = F.col("closed")
    road = F.when(tag("highway").isNotNull(), F.when(tag("highway").isin(*MAJOR_ROADS), "roads_major").otherwise("roads_local"))
    water = tag("waterway").isNotNull() | (F.coalesce(tag("natural"), F.lit("")) == "water")
    layers = F.array(
        road, F.when(water, "water_line"), F.when(water & closed, "water_area"), F.when(tag("boundary").isNotNull(), "boundaries"),
        F.when(tag("building").isNotNull() & closed, "buildings"), F.when(tag("landuse").isNotNull() & closed, "context"), F.when(tag("place").isNotNull(), "places"),
    )
    return elements.withColumn("layer", F.explode(F.array_compact(layers)))


def counts(layers: DataFrame) -> DataFrame:
    """Features of each layer, how many of them are closed, and the total of all layers."""
    per_layer = layers.groupBy("layer").agg(F.count("*").alias("n"), F.count_if("closed").alias("closed"))
    return per_layer.join(F.broadcast(per_layer.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))))
