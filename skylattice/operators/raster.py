"""Grids as pixel tables (scene_id, y, x, values): joins, resampling, statistics, tiles.

Pixels of one scene lie in many rows, so every operator is a join or aggregation on (scene_id, y, x) or
on a coarser key that comes from it; nothing needs a scene in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles

KEY = ["scene_id", "y", "x"]


def stack_bands(long: DataFrame, bands: list[str]) -> DataFrame:
    """(scene_id, y, x, band, value) to one column for each band."""
    return long.groupBy(*KEY).pivot("band", bands).agg(F.first("value"))


def aligned(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Pixels of two rasters on one grid; columns get ``_1`` and ``_2``."""
    one = a.select(*KEY, *(F.col(n).alias(f"{n}_1") for n in names))
    two = b.select(*KEY, *(F.col(n).alias(f"{n}_2") for n in names))
    return one.join(two, KEY)


def _targets(grids: DataFrame, height: int, width: int) -> DataFrame:
    rows = grids.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("scene_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def nearest(source: DataFrame, grids: DataFrame, height: int, width: int, to_source: tuple[float, ...], value: str) -> DataFrame:
    """Values of the source pixels under the centres of a target grid, 0 outside. ``to_source`` is the
    affine from target to source pixels."""
    a, b, c, d, e, f = to_source
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    at = _targets(grids, height, width).withColumn("sx", F.floor(a * cx + b * cy + c).cast("int")).withColumn("sy", F.floor(d * cx + e * cy + f).cast("int"))
    held = source.select("scene_id", F.col("y").alias("sy"), F.col("x").alias("sx"), value)
    return at.join(held, ["scene_id", "sy", "sx"], "left").select(*KEY, F.coalesce(value, F.lit(0)).alias(value))


def bilinear(source: DataFrame, grids: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """``value`` at a grid of another size over the same extent, from the four nearest centres; edges repeat. Where the source
    lacks pixels, those of the four that it has share the weight; a centre without any gets no row."""

    def axis(i, n: int, m: int):
        return F.greatest((F.col(i) + 0.5) * (n / m) - 0.5, F.lit(0.0))

    at = _targets(grids, to_height, to_width).withColumn("fy", axis("y", height, to_height)).withColumn("fx", axis("x", width, to_width))
    corners = at.withColumn("d", F.explode(F.array(*(F.struct(F.lit(j).alias("y"), F.lit(k).alias("x")) for j in (0, 1) for k in (0, 1)))))

    def part(f: str, d: str, n: int):
        low = F.floor(f)
        share = F.col(f) - low
        return F.least(low + F.col(d), F.lit(n - 1)).cast("int"), F.when(F.col(d) == 0, 1 - share).otherwise(share)

    (sy, wy), (sx, wx) = part("fy", "d.y", height), part("fx", "d.x", width)
    held = source.select("scene_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    return (
        corners.select(*KEY, sy.alias("sy"), sx.alias("sx"), (wy * wx).alias("w")).join(held, ["scene_id", "sy", "sx"])
        .groupBy(*KEY).agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.sum("w").alias("w"))
        .filter("w > 0").select(*KEY, (F.col("value") / F.col("w")).alias("value"))
    )


def average_down(source: DataFrame, factor: int, value: str) -> DataFrame:
    """Means of blocks of ``factor`` by ``factor`` pixels."""
    y, x = (F.floor(F.col(k) / factor).cast("int").alias(k) for k in ("y", "x"))
    return source.groupBy("scene_id", y, x).agg(F.avg(value).alias("value"))


def crop(source: DataFrame, transform: tuple[float, ...], box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centres lie in a map box; the affine must have no rotation, so that the box is a range of
    rows and columns that a scan can prune."""
    a, _, c, _, e, f = transform
    xs, ys = sorted(((box[0] - c) / a, (box[2] - c) / a)), sorted(((box[1] - f) / e, (box[3] - f) / e))
    return source.filter((F.col("x") + 0.5 >= xs[0]) & (F.col("x") + 0.5 < xs[1]) & (F.col("y") + 0.5 >= ys[0]) & (F.col("y") + 0.5 < ys[1]))


def grid_checks(grids: DataFrame, reference: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each grid and property: PASS if it equals the reference's (null equals null)."""
    one = reference.select(*(F.col(n).alias(f"r_{n}") for n in names)).limit(1)
    checks = [F.struct(F.lit(n).alias("check_name"), F.when(F.col(n).eqNullSafe(F.col(f"r_{n}")), "PASS").otherwise("FAIL").alias("verdict")) for n in names]
    return grids.join(F.broadcast(one)).select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def mask_statistics(df: DataFrame) -> DataFrame:
    valid = F.count_if("valid")
    return df.groupBy("scene_id").agg(
        F.count("*").alias("total"), valid.alias("valid"), (F.count("*") - valid).alias("masked"), F.round(valid / F.count("*"), 6).alias("valid_fraction")
    )


def positions(extent: int, size: int, n: int) -> list[int]:
    """``n`` starts from 0 to the last that fits, evenly spaced and truncated."""
    last = max(extent - size, 0)
    return [i * last // (n - 1) for i in range(n)] if n > 1 else [0]


def sampled_statistics(df: DataFrame, height: int, width: int, size: int, n: int) -> DataFrame:
    """Statistics of ``value`` over n by n windows; pixels in several windows count for each. Pixels without a value (null, NaN, infinite) are
    masked: they count in ``n`` and lower ``valid_fraction`` only."""

    def covering(k: str, extent: int):
        hits = [F.when((F.col(k) >= s) & (F.col(k) < s + size), 1).otherwise(0) for s in positions(extent, size, n)]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        return total

    times = covering("y", height) * covering("x", width)
    held = df.withColumn("times", times).filter("times > 0").withColumn("value", F.when(finite(F.col("value")), F.col("value")))
    valid = F.sum(F.when(F.col("value").isNotNull(), F.col("times")).otherwise(0))
    return held.groupBy("scene_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.try_divide(F.sum(F.col("value") * F.col("times")), valid), 6).alias("mean"),
        F.sum("times").cast("long").alias("n"), F.round(valid / F.sum("times"), 6).alias("valid_fraction"),
    )


def finite(c: Column) -> Column:
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def pair_similarity(rows: DataFrame) -> DataFrame:
    """How alike the two dates of each pair are: correlation and mean difference of the channels, and the normalised difference of all pixels and
    channels. ``rows``: pair_id, channel, y, x, a, b; pixels that are not finite at both dates are left out. Quantiles are
    exact and come from range partitions."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    held = rows.filter(finite(a) & finite(b)).select("pair_id", "channel", a.alias("a"), b.alias("b"))
    size, gap = F.abs("a") + F.abs("b"), F.abs(F.col("b") - F.col("a"))
    held = held.withColumn("nd", (F.col("b") - F.col("a")) / (size + 1e-8))
    per_channel = held.groupBy("pair_id", "channel").agg(F.corr("a", "b").alias("r"), F.avg(gap).alias("mae"))
    channels = per_channel.groupBy("pair_id").agg(
        F.percentile("r", 0.5).alias("pearson_median"), F.min("r").alias("pearson_low"), F.max("r").alias("pearson_high"), F.percentile("mae", 0.5).alias("mae_median")
    )
    whole = held.groupBy("pair_id").agg(
        (F.avg(gap) / (F.avg(size / 2) + 1e-8)).alias("relative_mae"), F.min("nd").alias("nd_low"), F.max("nd").alias("nd_high"), F.avg("nd").alias("nd_mean"),
        F.avg((F.abs("nd") >= 0.5).cast("int")).alias("over_half"), F.avg((F.abs("nd") >= 0.8).cast("int")).alias("over_08"),
    )
    q = quantiles(held, ["pair_id"], "nd", [0.5, 0.9, 0.95, 0.99]).select("pair_id", *(F.col("q")[k].alias(c) for k, c in enumerate(("nd_median", "nd_p90", "nd_p95", "nd_p99"))))
    found = channels.join(whole, "pair_id").join(q, "pair_id")
    return found.select("pair_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in found.columns if c != "pair_id"))


def channel_values(rows: DataFrame) -> DataFrame:
    """Values of each channel of a pair at both dates (``side`` a and b): finite values from least to largest with their quantiles, and the shares of
    finite and zero pixels among all."""
    sides = rows.select("pair_id", "channel", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("v")) for c in "ab"))).alias("s")).select("pair_id", "channel", "s.*")
    key = ["pair_id", "channel", "side"]
    v = F.when(finite(F.col("v")), F.col("v"))
    shares = sides.groupBy(*key).agg(
        F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.avg(finite(F.col("v")).cast("int")).alias("finite_share"), F.avg(F.coalesce(F.col("v") == 0, F.lit(False)).cast("int")).alias("zero_share")
    )
    q = quantiles(sides.withColumn("v", v), key, "v", [0.5, 0.9, 0.95, 0.99]).select(*key, *(F.col("q")[k].alias(c) for k, c in enumerate(("median", "p90", "p95", "p99"))))
    found = shares.join(q, key, "left")
    return found.select(*key, *(F.round(c, 6).alias(c) for c in found.columns if c not in key))


def distinct_values(rows: DataFrame, by: str, value: str, most: int = 32) -> DataFrame:
    """(by, values): the smallest ``most`` distinct values of each group, in order; nulls are none."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(value))
    kept = rows.select(by, value).filter(F.col(value).isNotNull()).distinct().withColumn("_place", place).filter(F.col("_place") <= most)
    return kept.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("values"))


def tile_statistics(df: DataFrame, size: int, width: int, least: float) -> DataFrame:
    """Numbered tiles (row-major) with the share of valid pixels; padding counts as invalid."""
    across = -(-width // size)
    ty, tx = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    share = F.round(F.count_if("valid") / float(size * size), 6)
    return (
        df.groupBy("scene_id", (ty * across + tx).cast("int").alias("tile_no")).agg(share.alias("valid_fraction"))
        .withColumn("accepted", F.col("valid_fraction") >= least)
    )


def delta_report(df: DataFrame) -> DataFrame:
    """Report on differences ``d`` of each scene."""
    d = F.col("d")

    def percent(condition):
        return F.round(100 * F.avg(condition.cast("int")), 6)

    return df.groupBy("scene_id").agg(
        F.count("d").alias("finite"), (F.count("*") - F.count("d")).alias("invalid"), F.round(F.min("d"), 6).alias("low"), F.round(F.max("d"), 6).alias("high"),
        F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", 0.5), 6).alias("median"), percent(d < 0).alias("decrease_pct"),
        percent(d > 0).alias("increase_pct"), percent(d <= -0.1).alias("strong_decrease_pct"), percent(d >= 0.1).alias("strong_increase_pct"),
    )


def overlapping_tiles(df: DataFrame, size: int, stride: int, extent: int, least: float) -> DataFrame:
    """Tiles of a grid whose tiles may overlap, with the share of valid pixels; a pixel goes to each tile that covers it."""

    def covering(k: str):
        first = F.greatest(F.ceil((F.col(k) - size + 1) / stride), F.lit(0))
        last = F.least(F.floor(F.col(k) / stride), F.lit((extent - 1) // stride))
        return F.transform(F.sequence(first, last), lambda i: (i * stride).cast("int"))

    tops = df.filter("valid").select("scene_id", "x", F.explode(covering("y")).alias("top"))
    both = tops.select("scene_id", "top", F.explode(covering("x")).alias("left"))
    share = F.col("n") / float(size * size)
    starts = F.col("top").isin(_starts(extent, size, stride)) & F.col("left").isin(_starts(extent, size, stride))
    return both.filter(starts).groupBy("scene_id", "top", "left").agg(F.count("*").alias("n")).filter(share >= least).select("scene_id", "top", "left", F.round(share, 6).alias("valid_fraction"))


def _starts(extent: int, size: int, stride: int) -> list[int]:
    found = [0]
    while found[-1] + size < extent:
        found.append(found[-1] + stride)
    return found


def mosaic(patches: DataFrame) -> DataFrame:
    """Pixels of patches at their place in the scene, with how many patches cover each."""
    at = patches.select("scene_id", (F.col("top") + F.col("i")).alias("y"), (F.col("left") + F.col("j")).alias("x"), "p")
    return at.groupBy(*KEY).agg(F.first("p").alias("p"), F.count("*").alias("times"))


def mosaic_checks(patches: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels covered, whether all are, and how many are covered twice."""
    return mosaic(patches).groupBy("scene_id").agg(
        F.count("*").alias("covered"), (F.count("*") == height * width).alias("complete"), F.count_if(F.col("times") > 1).alias("overlapping")
    )
