"""Change analysis of raster pairs as one job.

Rasters are headers (one row each) and pixels. Pairs that fit are cut into patches; every patch travels as Arrow batches to a
scorer that the user gives, and comes back as pixels with a probability and validity. Masks, components, candidates, ranks, map
places and statistics follow, and everything is written with its provenance.

One shuffle brings both dates of a patch to one task; a task holds one patch and a batch of rows. Headers are joined to pixels by raster, so a
raster may stand in many pairs. Grids of different sizes run together: sizes are columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import stage
from . import components
from .groups import Arrays, map_groups
from .ranking import with_rank

#: (bands, rows, columns) of the first and the second date, invalid pixels 0, to probabilities (rows, columns).
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.96
    raw_threshold: float = 0.5
    least_area: int = 32
    close: bool = False
    reject_edge: bool = False
    least_valid: float = 0.0
    patch: int = 256
    bands: tuple[str, ...] = ("b04", "b03", "b02")

    def __post_init__(self) -> None:
        if not (0 <= self.threshold <= 1 and 0 <= self.raw_threshold <= 1 and self.least_area >= 0 and self.patch > 0 and self.bands):
            raise ValueError(f"settings out of range: {self}")


def logistic_scorer(scale: float = 50.0, shift: float = 2.0, digits: int = 6) -> Scorer:
    """The default: logistic of the length of the change vector."""

    def score(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-(np.sqrt(((after - before) ** 2).sum(axis=0)) / scale - shift))), digits)

    return score


def _score_patch(scorer: Scorer, patch: int, bands: tuple[str, ...]):
    def run(rows: Arrays) -> Arrays:
        scene, top, left = rows["scene_id"][0], int(rows["py"][0]) * patch, int(rows["px"][0]) * patch
        h, w = min(patch, int(rows["height"][0]) - top), min(patch, int(rows["width"][0]) - left)
        dates, valid = [], np.ones(patch * patch, bool)
        for role in (1, 2):
            own = np.flatnonzero(rows["role"] == role)
            at = (rows["y"][own].astype(np.int64) - top) * patch + rows["x"][own] - left
            if len(own) and np.bincount(at).max() > 1:
                raise ValueError(f"a pixel of analysis {scene} comes twice")
            values = np.stack([rows[b][own] for b in bands])
            here = np.zeros(patch * patch, bool)
            here[at] = rows["valid"][own] & np.isfinite(values).all(axis=0)
            image = np.zeros((len(bands), patch * patch))
            image[:, at] = values
            dates.append(np.where(here, image, 0.0).reshape(len(bands), patch, patch))
            valid &= here
        p = np.asarray(scorer(*dates), np.float64)
        if p.shape != (patch, patch):
            raise ValueError(f"the scorer gave {p.shape} for a patch of {patch}")
        if not (np.isfinite(p) & (p >= 0) & (p <= 1)).all():
            raise ValueError(f"a probability of analysis {scene} is outside [0, 1]")
        valid = valid.reshape(patch, patch)[:h, :w]
        y, x = (a.reshape(-1).astype(np.int32) for a in np.indices((h, w)))
        return {"scene_id": np.full(h * w, scene, np.int64), "y": y + np.int32(top), "x": x + np.int32(left), "p": np.where(valid, p[:h, :w], 0.0).astype(np.float32).reshape(-1), "valid": valid.reshape(-1)}

    return run


def score_pairs(pairs: DataFrame, pixels: DataFrame, scorer: Scorer, patch: int = 256, bands: tuple[str, ...] = Settings.bands) -> DataFrame:
    """(scene_id, y, x, p, valid) for every pixel of each pair's grid. ``pairs``: scene_id, raster_1, raster_2, height, width;
    ``pixels``: raster_id, y, x, bands, valid. Pixels that a raster lacks, and values that are not finite, are invalid and
    score 0; patches without any pixel are there too."""
    roles = pairs.select("scene_id", "height", "width", F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.col(f"raster_{k}").alias("raster_id")) for k in (1, 2)))).alias("r"))
    roles = roles.select("scene_id", "height", "width", "r.role", "r.raster_id")
    grid = ["scene_id", "py", "px", "height", "width"]
    py, px = (F.floor(F.col(c) / patch).cast("int").alias(n) for c, n in (("y", "py"), ("x", "px")))
    inside = pixels.join(roles, "raster_id").filter("y >= 0 AND x >= 0 AND y < height AND x < width")
    held = inside.select("scene_id", py, px, "height", "width", "role", "y", "x", *(F.col(b).cast("double").alias(b) for b in bands), F.coalesce("valid", F.lit(False)).alias("valid"))
    steps = [F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / patch).cast("int"))).alias(n) for c, n in (("height", "py"), ("width", "px"))]
    every = pairs.select("scene_id", "height", "width", steps[0]).select("scene_id", "py", "height", "width", steps[1])
    marks = every.select(*grid, F.lit(0).alias("role"), F.lit(0).alias("y"), F.lit(0).alias("x"), *(F.lit(0.0).alias(b) for b in bands), F.lit(False).alias("valid"))
    return map_groups(held.unionByName(marks), ["scene_id", "py", "px"], _score_patch(scorer, patch, bands), "scene_id long, y int, x int, p float, valid boolean")


def mosaic(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """``scores`` once every pixel of every grid is there exactly once; else an error."""
    # the places of 64 columns of a row are the bits of one number
    bits = scores.groupBy("scene_id", "y", F.floor(F.col("x") / 64).alias("x64")).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, pmod(x, 64))")).alias("bits"))
    n = bits.groupBy("scene_id").agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits")).alias("places"))
    wrong = pairs.join(n, "scene_id", "left").filter("n IS NULL OR n <> places OR n <> height * width")
    if not wrong.isEmpty():
        raise ValueError("patches of an analysis overlap or leave pixels out")
    return scores


def located(found: DataFrame) -> DataFrame:
    """Candidates (pixel box and centroid, transform) with their box and centroid on the map."""
    corners = [(geo.map_x(F.col("transform"), F.col(x), F.col(y)), geo.map_y(F.col("transform"), F.col(x), F.col(y))) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    east, north = ([c[k] for c in corners] for k in (0, 1))
    x, y = F.col("centroid_x") + 0.5, F.col("centroid_y") + 0.5
    return found.select(
        "*", F.least(*east).alias("map_xmin"), F.least(*north).alias("map_ymin"), F.greatest(*east).alias("map_xmax"), F.greatest(*north).alias("map_ymax"),
        geo.map_x(F.col("transform"), x, y).alias("map_x"), geo.map_y(F.col("transform"), x, y).alias("map_y"),
    )


@dataclass(frozen=True)
class Analysis:
    """What a job has written: pixels (analysis_id, y, x, probability, raw, final, valid), ranked candidates, and one row of
    metadata for each analysis."""

    pixels: DataFrame
    candidates: DataFrame
    metadata: DataFrame


def _number(pairs: DataFrame, settings: Settings, model: str) -> DataFrame:
    """Pairs with scene_id, a number for each, and analysis_id, a digest of pair, model and settings: the same job run
    again has the same names."""
    plan = json.dumps(asdict(settings) | {"model": model}, sort_keys=True)
    named = pairs.withColumn("analysis_id", F.sha2(F.concat_ws("|", "pair_id", "raster_1", "raster_2", F.lit(plan)), 256))
    return stage(with_rank(named, ["analysis_id"], "scene_id").withColumn("scene_id", F.col("scene_id").cast("long")), "analyses")


def analyse(pairs: DataFrame, pixels: DataFrame, scorer: Scorer, path: str, settings: Settings = Settings(), model: str = "logistic", score: Column | None = None) -> Analysis:
    """Run the job for accepted ``pairs`` (pair_id, raster_1, raster_2, acquired_1, acquired_2, sensor, crs, transform, height,
    width, unit_m) and write it under ``path``. ``score`` ranks candidates; by default their mean probability."""
    spark, s = pairs.sparkSession, settings
    pairs = _number(pairs, s, model)
    scores = mosaic(stage(score_pairs(pairs, pixels, scorer, s.patch, s.bands), "scores"), pairs)

    sized = scores.join(pairs.select("scene_id", "height", "width"), "scene_id")
    final = stage(components.postprocess(sized, s.threshold, s.least_area, s.close, "height", "width"), "final-mask")
    labels = stage(components.numbered(components.label(final)), "final-labels")
    found = components.candidates(labels, sized, s.threshold, F.col("height"), F.col("width"))
    judged = components.rejected(found, s.reject_edge, s.least_valid)
    ranked = components.ranked(judged, F.col("mean_p") if score is None else score)
    headers = pairs.select("scene_id", "analysis_id", "pair_id", "crs", "transform", "unit_m")
    area = geo.pixel_area(F.col("transform"), F.col("unit_m"))
    placed = located(ranked.join(headers, "scene_id")).withColumn("area_m2", F.col("area") * area)
    placed.drop("scene_id", "transform", "unit_m").write.parquet(f"{path}/candidates")

    raw = F.col("valid") & (F.col("p") >= F.lit(s.raw_threshold).cast("float"))
    masks = scores.join(final.withColumn("final", F.lit(True)), components.KEY, "left").join(pairs.select("scene_id", "analysis_id"), "scene_id")
    masks = masks.select("analysis_id", "y", "x", F.col("p").alias("probability"), raw.cast("int").alias("raw"), F.coalesce("final", F.lit(False)).cast("int").alias("final"), "valid")
    masks.sortWithinPartitions("analysis_id", "y", "x").write.parquet(f"{path}/pixels")

    _metadata(spark, pairs, labels, scores, f"{path}/candidates", s, model).write.json(f"{path}/metadata")
    return read_analysis(spark, path)


def _metadata(spark: SparkSession, pairs: DataFrame, labels: DataFrame, scores: DataFrame, written: str, s: Settings, model: str) -> DataFrame:
    """A JSON document for each analysis: inputs, grid, settings, statistics, accounting of the filter, provenance."""
    stats = components.component_statistics(labels.select(*components.KEY, "root"), scores)
    books = components.accounting(spark.read.parquet(written).withColumn("scene_id", F.col("analysis_id"))).withColumnRenamed("scene_id", "analysis_id")
    rows = pairs.join(stats, "scene_id", "left").join(books, "analysis_id", "left")
    t, area = F.col("transform"), geo.pixel_area(F.col("transform"), F.col("unit_m"))
    x, y = F.array(*(geo.map_x(t, F.col("width") * a, F.col("height") * b) for a in (0, 1) for b in (0, 1))), F.array(*(geo.map_y(t, F.col("width") * a, F.col("height") * b) for a in (0, 1) for b in (0, 1)))
    zero = F.lit(0).cast("long")
    document = F.struct(
        "analysis_id", "pair_id", "raster_1", "raster_2", F.date_format("acquired_1", "yyyy-MM-dd'T'HH:mm:ss").alias("acquired_1"), F.date_format("acquired_2", "yyyy-MM-dd'T'HH:mm:ss").alias("acquired_2"),
        "sensor", "crs", "transform", "width", "height", F.array(F.abs(t[0]), F.abs(t[4])).alias("resolution"), F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)).alias("bounds"),
        area.alias("pixel_area_m2"), F.lit(model).alias("model"),
        F.struct("valid", "changed", "percent", "components", "largest", "median", (F.col("changed") * area).alias("changed_area_m2")).alias("statistics"),
        F.struct(*(F.coalesce(c, zero).alias(c) for c in ("removed_components", "retained_components", "removed_pixels", "retained_pixels"))).alias("filtering"),
        F.struct(
            F.lit(s.threshold).alias("threshold"), F.lit(s.raw_threshold).alias("raw_threshold"), F.lit(s.least_area).alias("least_area"), F.lit("closing" if s.close else "none").alias("morphology"),
            F.lit(8).alias("connectivity"), F.lit(s.reject_edge).alias("reject_edge"), F.lit(s.least_valid).alias("least_valid"), F.lit(s.patch).alias("patch"),
        ).alias("settings"),
        F.struct(
            F.lit(",".join(s.bands)).alias("bands"), F.lit("valid at both dates and finite in all bands; other pixels score 0").alias("quality_mask"),
            F.lit("given dates keep their roles").alias("temporal_order"), F.lit("mean probability ranks only, it is not calibrated").alias("score"),
        ).alias("provenance"),
    )
    return rows.select(document.alias("d")).select("d.*")


def read_analysis(spark: SparkSession, path: str) -> Analysis:
    return Analysis(spark.read.parquet(f"{path}/pixels"), spark.read.parquet(f"{path}/candidates"), spark.read.json(f"{path}/metadata"))
