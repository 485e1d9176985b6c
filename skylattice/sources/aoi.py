"""Areas of interest: GeoJSON with checks, boxes of rings, and the registry's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store

FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"


def ring_box(rings: Column) -> Column:
    """Bounding box of the points of all rings (array of arrays of [lng, lat])."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def load(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(name, rings): one row for each feature (a file each, or a line each without ``multi_line``); anything but a Feature with a filled Polygon or MultiPolygon fails."""
    rows = spark.read.schema(FEATURE).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    ok = (F.col("type") == "Feature") & rings.isNotNull() & (F.size(F.flatten(rings)) > 0)
    fail = F.raise_error(F.lit("an area must be a Feature with a Polygon or MultiPolygon that has points")).cast("array<array<array<double>>>")
    return rows.select(F.col("properties")["name"].alias("name"), F.when(F.coalesce(ok, F.lit(False)), rings).otherwise(fail).alias("rings"))


def checked(rows: DataFrame) -> DataFrame:
    """Adds ``reason``, the first rule that a row breaks (name, lat, lng, radius), null if none."""
    reason = (
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lat")
        .when(~F.coalesce(F.col("lng").between(-180, 180), F.lit(False)), "lng").when(~F.coalesce(F.col("radius_km") > 0, F.lit(False)), "radius")
    )
    return rows.withColumn("reason", reason)


def append(store: Store, rows: DataFrame, created: str, table: str = "areas") -> DataFrame:
    """Add the rows (name, lat, lng, radius_km) that are in order to a registry, with trimmed names, an id from name and time, and
    the time; the others come back with their ``reason``. An area that is there already is not added again."""
    judged = checked(rows)
    name = F.trim("name")
    good = judged.filter("reason IS NULL").select(
        F.substring(F.sha2(F.concat(name, F.lit("|"), F.lit(created)), 256), 1, 16).alias("area_id"), name.alias("name"), "lat", "lng", "radius_km", F.lit(created).alias("created")
    ).dropDuplicates(["area_id"])
    if store.current() is not None:
        held = store.read(table)
        good = held.unionByName(good.join(held.select("area_id"), "area_id", "left_anti"))
    store.commit({table: good}, {table: ["created", "area_id"]})
    return judged.filter("reason IS NOT NULL")
