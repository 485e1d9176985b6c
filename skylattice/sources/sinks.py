"""Sinks: result lists, layers and analysis artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import with_rank


def result_rows(rows: DataFrame, order: list) -> DataFrame:
    """Ranked rows as they are exported: places to five digits, day of acquisition."""
    return with_rank(rows, order).select(
        F.col("rank").cast("int").alias("rank"), "scene_id", F.round("ymin", 5).alias("lat"), F.round("xmin", 5).alias("lng"), F.date_format("acquired", "yyyy-MM-dd").alias("day")
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` has written."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_layers(features: DataFrame, path: str) -> None:
    """One folder of GeoJSON lines for each layer. ``features``: layer, geometry, properties."""
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", "properties"))
    features.select("layer", line.alias("value")).write.partitionBy("layer").text(path)


def write_bundles(lines: DataFrame, key: str, path: str) -> None:
    """The lines of ``reports.bundle`` as JSON, a folder for each part, sorted by case."""
    lines.repartitionByRange(key, "part", "seq").sortWithinPartitions("part", key, "seq").write.partitionBy("part").json(path)


def read_bundles(spark: SparkSession, key: str, kind: str, path: str) -> DataFrame:
    """What ``write_bundles`` has written."""
    return spark.read.schema(f"{key} {kind}, seq long, body string, part string").json(path)


def write_analysis(pixels: DataFrame, path: str) -> None:
    """Probability and masks by analysis; provenance travels as a column."""
    pixels.write.partitionBy("analysis_id").parquet(path)
