"""Training data: folds, patch grids, patches with padding, augmentation, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank


def folds(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Each key in one of ``k`` folds of nearly equal size, by the order of a digest."""
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    ranked = with_rank(rows.select(key, order.alias("_digest")), ["_digest"], "_i")
    return ranked.select(key, ((F.col("_i") - 1) % k).cast("int").alias("fold"))


def starts(extent: Column, patch: int, stride: int) -> Column:
    """Offsets 0, stride, ... below the extent; the last patch may reach over the edge."""
    last = F.greatest(F.ceil((extent - patch) / stride) * stride, F.lit(0)).cast("int")
    return F.sequence(F.lit(0), last, F.lit(stride))


def patch_grid(grids: DataFrame, patch: int, stride: int) -> DataFrame:
    """Row-major patches of each grid (scene_id, height, width)."""
    rows = grids.select("scene_id", "width", F.explode(starts(F.col("height"), patch, stride)).alias("top"))
    return rows.select("scene_id", "top", F.explode(starts(F.col("width"), patch, stride)).alias("left"))


def reflected(i: Column, extent: Column) -> Column:
    """Index of a mirrored position beyond the end, without the edge twice."""
    return F.when(i < extent, i).otherwise(2 * (extent - 1) - i)


def extract(grids: DataFrame, pixels: DataFrame, patch: int, stride: int, value: str, truth: str) -> DataFrame:
    """Pixels of every patch; beyond the bottom and right edges the values mirror, labels are 0 and invalid. A pixel that the
    grid lacks has no value, label 0, and is invalid."""
    size = F.sequence(F.lit(0), F.lit(patch - 1))
    cells = (
        patch_grid(grids, patch, stride).join(grids, "scene_id").withColumn("i", F.explode(size)).withColumn("j", F.explode(size))
        .withColumn("ty", F.col("top") + F.col("i")).withColumn("tx", F.col("left") + F.col("j"))
        .withColumn("y", reflected(F.col("ty"), F.col("height"))).withColumn("x", reflected(F.col("tx"), F.col("width")))
    )
    inside = (F.col("ty") < F.col("height")) & (F.col("tx") < F.col("width")) & F.col("_held").isNotNull()
    return cells.join(pixels.withColumn("_held", F.lit(True)), ["scene_id", "y", "x"], "left").select(
        "scene_id", "top", "left", "i", "j", value, F.when(inside, F.col(truth)).otherwise(0).alias("label"), inside.alias("valid")
    )


MOVES = ("identity", "flip_h", "flip_v", "rot90", "rot180", "rot270")


def augment(patches: DataFrame, size: int, choice: Column) -> DataFrame:
    """Rows and columns of a patch moved by one of six moves, the same for all its bands and labels."""
    i, j, last = F.col("i"), F.col("j"), size - 1
    to = {0: (i, j), 1: (i, last - j), 2: (last - i, j), 3: (last - j, i), 4: (last - i, last - j), 5: (j, last - i)}
    row = col = None
    for k, (a, b) in to.items():
        row = F.when(choice == k, a) if row is None else row.when(choice == k, a)
        col = F.when(choice == k, b) if col is None else col.when(choice == k, b)
    return patches.withColumn("ni", row).withColumn("nj", col)


def evenly(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced by rank, first and last among them."""
    ranked = with_rank(rows, [order], "_i").withColumn("_i", F.col("_i") - 1)
    total = rows.agg(F.count("*").alias("_n"))
    spots = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / (n - 1)))).alias("_i")).distinct()
    return ranked.join(F.broadcast(spots), "_i", "left_semi").drop("_i")


def inventory(bands: DataFrame, masks: DataFrame, n_bands: int, n_dates: int) -> DataFrame:
    """Each location's bands and dates, whether all its grids are equal, whether its mask has their shape, and whether it is complete.
    ``bands``: location, date, band, height, width; ``masks``: location, height, width."""
    by_date = bands.groupBy("location", "date").agg(
        F.countDistinct("band").alias("n"), F.min("height").alias("h0"), F.max("height").alias("h1"), F.min("width").alias("w0"), F.max("width").alias("w1")
    )
    rows = by_date.groupBy("location").agg(
        F.min("n").alias("least_bands"), F.max("n").alias("most_bands"), F.count("*").alias("dates"), F.max("h1").alias("height"), F.max("w1").alias("width"),
        ((F.min("h0") == F.max("h1")) & (F.min("w0") == F.max("w1"))).alias("same_grid"),
    )
    shape = masks.select("location", F.col("height").alias("mask_height"), F.col("width").alias("mask_width"))
    mask_ok = F.coalesce((F.col("height") == F.col("mask_height")) & (F.col("width") == F.col("mask_width")), F.lit(False))
    whole = (F.col("least_bands") == n_bands) & (F.col("dates") == n_dates) & F.col("same_grid") & mask_ok
    return rows.join(shape, "location", "left").select("location", "least_bands", "most_bands", "dates", "height", "width", "same_grid", mask_ok.alias("mask_ok"), whole.alias("complete"))
