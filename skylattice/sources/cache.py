"""A cache of unit vectors by tile, model and version.

Rows lie in folders by model version. The latest write of a key counts, so that a cached vector is renewed by
writing it again, and nothing that is read is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import list_names


def cache_key(tile_id):
    return F.sha2(tile_id, 256)


def write(rows: DataFrame, path: str, model: str) -> None:
    """Add ``rows`` (tile_id, vector, model_version, fingerprint), normalised; vectors without a finite positive norm stay out."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    kept = rows.withColumn("_norm", norm).filter((F.col("_norm") > 0) & (F.col("_norm") < F.lit(float("inf"))))
    turn = len(list_names(rows.sparkSession, path))
    kept.select(
        "tile_id", cache_key(F.col("tile_id")).alias("cache_key"), F.transform(v, lambda x: (x / F.col("_norm")).cast("float")).alias("vector"), F.size("vector").alias("dimension"),
        F.lit(model).alias("model"), "model_version", "fingerprint",
    ).write.partitionBy("model_version").parquet(f"{path}/turn={turn}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every key once, as it was written last."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in ("cache_key", "turn"))), "turn").alias("r")
    return rows.groupBy("cache_key").agg(last).select("cache_key", "r.*")


def usable(cached: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """``wanted`` (tile_id, model_version, dimension, fingerprint) with ``hit`` and, for a miss, the first ``reason``: absent, model,
    version, dimension, fingerprint, norm."""
    v = F.col("vector").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    held = cached.select("tile_id", F.col("model").alias("_model"), F.col("model_version").alias("_version"), F.col("dimension").alias("_dimension"), F.col("fingerprint").alias("_fingerprint"), norm.alias("_norm"))
    rows = wanted.join(held, "tile_id", "left")
    reason = (
        F.when(F.col("_model").isNull(), "absent").when(F.col("_model") != model, "model").when(F.col("_version") != F.col("model_version"), "version").when(F.col("_dimension") != F.col("dimension"), "dimension")
        .when(~F.col("_fingerprint").eqNullSafe(F.col("fingerprint")), "fingerprint").when(~(F.abs(F.col("_norm") - 1) <= 1e-5), "norm")
    )
    return rows.select(*wanted.columns, reason.isNull().alias("hit"), reason.alias("reason"))
