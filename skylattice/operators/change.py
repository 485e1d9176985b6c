"""Change analysis: scoring of pairs, evidence inside candidates, calibration and ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from . import components
from .components import KEY


def score_pairs(a: DataFrame, b: DataFrame, band: str, scale: float = 50.0, shift: float = 2.0) -> DataFrame:
    """Default scorer of aligned pairs: logistic of the change's size; invalid pixels score 0."""
    valid = pixels.scl_valid(F.col("scl"))
    both = a.join(b.select(*KEY, F.col(band).alias("then")), KEY)
    p = F.round(1 / (1 + F.exp(-(F.abs(F.col("then") - F.col(band)) / scale - shift))), 6)
    return both.select(*KEY, F.when(valid, p).otherwise(F.lit(0.0)).alias("p"), valid.alias("valid"))


def primary(ranked: DataFrame, preferred: int) -> DataFrame:
    """The preferred component of each scene if it is there, else the first by rank."""
    order = F.struct(F.when(F.col("component_id") == preferred, 0).otherwise(F.col("rank")), "component_id")
    return ranked.groupBy("scene_id").agg(F.min_by("component_id", order).alias("component_id"))


def evidence_inside(found: DataFrame, evidence: DataFrame, block: int = 256) -> DataFrame:
    """Mean ``evidence`` of the pixels inside each candidate's box. A candidate is replicated to the blocks
    that its box touches, so the range join is an equi-join on the block."""

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / block), F.floor((F.col(high) - 1) / block))

    dealt = found.withColumn("by", F.explode(span("ymin", "ymax"))).withColumn("bx", F.explode(span("xmin", "xmax")))
    cells = evidence.select("scene_id", "y", "x", "evidence", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"))
    inside = (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax")) & (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax"))
    return dealt.join(cells, ["scene_id", "by", "bx"]).filter(inside).groupBy("scene_id", "component_id").agg(
        F.round(F.avg("evidence"), 6).alias("mean_sar"), F.first("mean_p").alias("mean_p"), F.first("valid_fraction").alias("q")
    )


def verify(evidence: DataFrame) -> DataFrame:
    """Fused score, label and whether both sensors agree."""
    o, s, q = F.col("mean_p"), F.col("mean_sar"), F.col("q")
    return evidence.select(
        "scene_id", "component_id", "mean_sar", pixels.fusion_score(o, s, q).alias("score"), pixels.fusion_label(o, s).alias("label"),
        (pixels.agreement_category(o, s) == 3).alias("corroborated"),
    )


def error_components(labels: DataFrame, big: int) -> DataFrame:
    areas = labels.groupBy("scene_id", "root").agg(F.count("*").alias("area"))
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("area")))
    return areas.withColumn("i", rank).groupBy("scene_id").agg(
        F.count("*").alias("components"), F.max("area").alias("largest"),
        F.round(F.sum(F.when(F.col("i") <= 10, F.col("area")).otherwise(0)) / F.sum("area"), 6).alias("top10_share"), F.count_if(F.col("area") >= big).alias("big"),
    )


def pixel_distance(a: DataFrame, b: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """(scene_id, y, x, distance): mean absolute difference of the channels at the pixels that both dates have."""
    then = b.select(*KEY, *(F.col(c).alias(f"{c}_then") for c in channels))
    total = sum((F.abs(F.col(c).cast("double") - F.col(f"{c}_then")) for c in channels[1:]), F.abs(F.col(channels[0]).cast("double") - F.col(f"{channels[0]}_then")))
    return a.select(*KEY, *channels).join(then, KEY).select(*KEY, (total / len(channels)).alias("distance"))


def block_clusters(distances: DataFrame, size: int = 10, over: float = 30.0, share: float = 0.3, top: int = 5) -> DataFrame:
    """Largest 4-connected clusters of ``size`` by ``size`` blocks in which more than ``share`` of the pixels changed by more than ``over``, with the box
    of their blocks. Pixels that a block at the edge lacks have not changed. Clusters of one size by their first block."""
    blocks = (
        distances.filter(F.col("distance") > over)
        .groupBy("scene_id", F.floor(F.col("y") / size).cast("int").alias("y"), F.floor(F.col("x") / size).cast("int").alias("x"))
        .agg(F.count("*").alias("n")).filter(F.col("n") / (size * size) > share).select(*KEY)
    )
    box = (F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"))
    clusters = components.label(blocks, diagonal=False).groupBy("scene_id", "root").agg(F.count("*").alias("blocks"), *box)
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("blocks"), "root"))
    return clusters.withColumn("rank", rank).filter(F.col("rank") <= top).select("scene_id", "rank", "blocks", "top", "left", "bottom", "right")


def visual_report(distances: DataFrame, clusters: DataFrame, dates: DataFrame, over: float = 30.0) -> DataFrame:
    """One row for each scene: share of changed pixels and visual similarity in percent, days between the dates (null if one is unknown), regions.
    ``clusters`` as ``block_clusters`` gives them, ``dates``: scene_id, before, after."""
    far = F.avg((F.col("distance") > over).cast("int"))
    found = distances.groupBy("scene_id").agg(F.round(far * 100, 1).alias("delta"), F.round(100 - F.avg("distance") / 255 * 100, 1).alias("similarity"))
    days = F.abs(F.round((F.unix_timestamp("after") - F.unix_timestamp("before")) / 86400)).cast("int")
    regions = clusters.groupBy("scene_id").agg(F.count("*").alias("regions"))
    held = found.join(dates.select("scene_id", days.alias("days")), "scene_id", "left").join(regions, "scene_id", "left")
    return held.select("scene_id", "delta", "similarity", "days", F.coalesce("regions", F.lit(0).cast("long")).alias("regions"))


def choose(grid: DataFrame) -> DataFrame:
    """Best F1; of equals no morphology, then the smaller area, then the higher threshold."""
    best = F.struct("f1", (F.col("morphology") == "none"), -F.col("area"), "threshold")
    return grid.agg(F.max_by(F.struct("threshold", "area", "morphology", "f1"), best).alias("c")).select("c.*")


def edge_ablation(labels: DataFrame, judged: DataFrame, px: DataFrame) -> DataFrame:
    """Pooled counts with all components, and without those that are rejected."""
    rows = labels.join(judged.select("scene_id", "component_id", "retained"), ["scene_id", "component_id"]).join(px.select(*KEY, "truth"), KEY)
    hit = F.col("truth") == 1
    both = rows.select("truth", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("retained"), "without_edge")))).alias("variant"))
    counts = both.groupBy("variant").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    fn = F.col("pos") - F.col("tp")
    return counts.join(F.broadcast(px.agg(F.sum("truth").alias("pos")))).select(
        "variant", "tp", "fp", fn.alias("fn"), F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn), 6).alias("f1")
    )
