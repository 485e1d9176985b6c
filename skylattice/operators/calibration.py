"""Calibration of threshold, least area and morphology over all settings at once.

Masks of rising thresholds are nested, so their components form a tree. Every block of a scene builds its part of the tree in one
task: thresholds fall, pixels join, labels of the level above go on. A pixel keeps its label at each level that it reaches.
Labels that touch across block borders are linked level by level, and the least label spreads over those links. Areas
and hits are sums over (level, component), so settings without morphology need no pixel again. For the closing each block comes
back with the areas of its components and a rim of two pixels, and all settings are counted in that task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .components import BLOCK, KEY, WIDEST, roots

# The settings of a calibration.
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99)
AREAS = (0, 16, 32, 64, 128)

_STEPS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
RIM = 2


def _label_levels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of one block at all levels: the least code of a pixel of the component inside the block."""
    y, x, level = (pdf[c].to_numpy(np.int64) for c in ("y", "x", "level"))
    top, left, far = y.min(), x.min(), np.iinfo(np.int64).max
    grid = np.full((y.max() - top + 3, x.max() - left + 3), far)
    code, found = y * WIDEST + x, np.full((len(y), level.max(initial=0)), far)
    for k in range(level.max(initial=0), 0, -1):
        here = level >= k
        at = (y[here] - top + 1, x[here] - left + 1)
        new = level[here] == k
        grid[at[0][new], at[1][new]] = code[here][new]
        labels = grid[at]
        while True:
            low = labels
            for dy, dx in _STEPS:
                low = np.minimum(low, grid[at[0] + dy, at[1] + dx])
            low = np.minimum(low, grid[low // WIDEST - top + 1, low % WIDEST - left + 1])
            if (low == labels).all():
                break
            grid[at] = labels = low
        found[here, k - 1] = labels
    return pd.DataFrame({"scene_id": pdf["scene_id"], "y": pdf["y"], "x": pdf["x"], "truth": pdf["truth"], "level": pdf["level"], "labels": [row[:k] for row, k in zip(found, level, strict=True)]})


def nested_labels(px: DataFrame, thresholds: tuple[float, ...], block: int = BLOCK) -> DataFrame:
    """(scene_id, y, x, truth, level, labels): the number of thresholds that p reaches, and the label in the block at each of them.
    ``thresholds`` rise; p and they are compared as floats."""
    level = sum((F.col("p") >= F.lit(t).cast("float")).cast("int") for t in thresholds)
    rows = px.select(*KEY, F.col("truth").cast("int").alias("truth"), F.coalesce(level, F.lit(0)).alias("level"))
    by, bx = F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")
    return rows.groupBy("scene_id", by, bx).applyInPandas(_label_levels, "scene_id long, y int, x int, truth int, level int, labels array<long>")


def _border_links(local: DataFrame, block: int) -> DataFrame:
    edge = local.filter((F.col("level") > 0) & ((F.col("y") % block).isin(0, block - 1) | (F.col("x") % block).isin(0, block - 1)))
    ahead = F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))))
    moved = edge.select("scene_id", F.col("labels").alias("la"), F.explode(ahead).alias("at")).select("scene_id", "la", "at.y", "at.x")
    both = moved.join(edge.select(*KEY, F.col("labels").alias("lb")), KEY)
    n = F.least(F.size("la"), F.size("lb"))
    pairs = both.select("scene_id", F.posexplode(F.arrays_zip(F.slice("la", 1, n).alias("a"), F.slice("lb", 1, n).alias("b"))).alias("level", "l"))
    return pairs.select("scene_id", "level", "l.*").filter("a <> b").select("scene_id", "level", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def component_table(local: DataFrame, block: int = BLOCK) -> DataFrame:
    """(scene_id, level, label, n, pos, area): each block's part of a component at a level (0 the lowest), its pixels and true
    pixels, and the area of the whole component."""
    parts = local.select("scene_id", "truth", F.posexplode("labels").alias("level", "label")).groupBy("scene_id", "level", "label").agg(F.count("*").alias("n"), F.sum("truth").alias("pos"))
    links = stage(_border_links(local, block), "links")
    if links.isEmpty():
        return stage(parts.withColumn("area", F.col("n")), "parts")
    named = stage(parts.join(roots(links, ["scene_id", "level"]), ["scene_id", "level", "label"], "left").withColumn("root", F.coalesce("root", "label")), "parts")
    areas = named.groupBy("scene_id", "level", "root").agg(F.sum("n").alias("area"))
    return stage(named.join(areas, ["scene_id", "level", "root"]).drop("root"), "parts")


def _classes(key: tuple, pixels: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """For each pixel of a block the class of its component at each level, as bytes."""
    class_of = dict(zip(zip(parts["level"], parts["label"], strict=True), parts["passed"], strict=True))
    held = [bytes(class_of[k, label] for k, label in enumerate(labels)) for labels in pixels["labels"]]
    return pixels[["scene_id", "y", "x", "truth"]].assign(classes=held)


def _count_closed(n_levels: int, n_areas: int, block: int, height: int, width: int):
    def neighbours(mask: np.ndarray, start: bool) -> np.ndarray:
        out = mask.copy()
        for axis in (0, 1):
            before = out
            wide = np.pad(before, 1, constant_values=False)
            parts = [np.take(wide, range(k, k + before.shape[axis]), axis=axis) for k in (0, 1, 2)]
            parts = [p[:, 1:-1] if axis == 0 else p[1:-1] for p in parts]
            out = parts[0] | parts[1] | parts[2] if start else parts[0] & parts[1] & parts[2]
        return out

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left, side = key[1] * block - RIM, key[2] * block - RIM, block + 2 * RIM
        side_y, side_x = min(side, height - top + RIM), min(side, width - left + RIM)
        y, x = pdf["y"].to_numpy(np.int64) - top, pdf["x"].to_numpy(np.int64) - left
        classes = np.zeros((n_levels, side_y, side_x), np.uint8)
        for k in range(n_levels):
            classes[k, y, x] = [c[k] if k < len(c) else 0 for c in pdf["classes"]]
        there, truth = np.zeros((side_y, side_x), bool), np.zeros((side_y, side_x), bool)
        core = (y >= RIM) & (x >= RIM) & (y < RIM + block) & (x < RIM + block)
        there[y[core], x[core]] = True
        truth[y, x] = pdf["truth"].to_numpy() == 1
        rows, columns = np.arange(side_y) + top, np.arange(side_x) + left
        inside = ((rows >= 0) & (rows < height))[:, None] & ((columns >= 0) & (columns < width))
        out = []
        for k in range(n_levels):
            for i in range(n_areas):
                closed = neighbours(neighbours(classes[k] > i, True) & inside, False) & there
                out.append((k, i, int((closed & truth).sum()), int((closed & ~truth).sum())))
        return pd.DataFrame(out, columns=["level", "i", "tp", "fp"])

    return run


def calibration_grid(px: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[int, ...] = AREAS, height: int = BLOCK, width: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """Pooled counts and F1 for each threshold, least area and morphology. ``px``: scene_id, y, x, p, truth (0 or 1)."""
    thresholds, areas, spark = tuple(sorted(set(thresholds))), tuple(sorted(set(areas))), px.sparkSession
    local = stage(nested_labels(px, thresholds, block), "nested")
    passed = sum((F.col("area") >= a).cast("int") for a in areas)
    parts = component_table(local, block).withColumn("passed", passed)

    counted = parts.filter("passed > 0").select("level", F.explode(F.sequence(F.lit(0), F.col("passed") - 1)).alias("i"), "n", "pos")
    none = counted.groupBy("level", "i").agg(F.sum("pos").alias("tp"), F.sum(F.col("n") - F.col("pos")).alias("fp")).withColumn("morphology", F.lit("none"))

    home = [F.floor(F.col(c) / block).cast("int").alias(b) for c, b in (("y", "by"), ("x", "bx"))]
    of_label = [F.floor(F.expr(e) / block).cast("int").alias(b) for e, b in ((f"label div {WIDEST}L", "by"), (f"label % {WIDEST}L", "bx"))]
    own = parts.select("scene_id", *of_label, "level", "label", "passed")
    classes = stage(
        local.select("scene_id", *home, "y", "x", "truth", "labels").groupBy("scene_id", "by", "bx").cogroup(own.groupBy("scene_id", "by", "bx")).applyInPandas(_classes, "scene_id long, y int, x int, truth int, classes binary"),
        "classes",
    )
    near = [F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / block).cast("int") for d in (-RIM, 0, RIM))))).alias(b) for c, b in (("y", "by"), ("x", "bx"))]
    spread = classes.select("*", near[0]).select("*", near[1])
    spread = spread.filter((F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") * block < height) & (F.col("bx") * block < width))
    closed = spread.groupBy("scene_id", "by", "bx").applyInPandas(_count_closed(len(thresholds), len(areas), block, height, width), "level int, i int, tp long, fp long")
    closed = closed.groupBy("level", "i").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).withColumn("morphology", F.lit("closing"))

    totals = px.agg(F.count("*").alias("all"), F.sum("truth").alias("pos"))
    settings = spark.createDataFrame([(k, t, i, a, m) for k, t in enumerate(thresholds) for i, a in enumerate(areas) for m in ("none", "closing")], "level int, threshold double, i int, area int, morphology string")
    rows = F.broadcast(settings).join(none.unionByName(closed), ["level", "i", "morphology"], "left").join(F.broadcast(totals))
    tp, fp = (F.coalesce(c, F.lit(0).cast("long")) for c in ("tp", "fp"))
    fn, scale = F.col("pos") - tp, F.col("pos") + tp + fp
    return rows.select(
        "threshold", "area", "morphology", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("all") - F.col("pos") - fp).alias("tn"),
        F.round(F.when(scale > 0, 2 * tp / scale).otherwise(F.lit(0.0)), 6).alias("f1"),
    )
