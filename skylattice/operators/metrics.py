"""Evaluation of predictions against truth. Counts are aggregated first, so that every score is arithmetic
on a small table and pooled scores come from summed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .ranking import quantiles, running_sums

COUNTS = ("tp", "fp", "fn", "tn")


def _counts(pred: Column, truth: Column) -> list[Column]:
    return [
        F.count_if((pred == 1) & (truth == 1)).alias("tp"), F.count_if((pred == 1) & (truth == 0)).alias("fp"),
        F.count_if((pred == 0) & (truth == 1)).alias("fn"), F.count_if((pred == 0) & (truth == 0)).alias("tn"),
    ]


def confusion(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*_counts(F.col("pred"), F.col("truth")))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, iou (0 on empty denominators) and the predicted and true percent."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    total = tp + fp + fn + tn
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "iou": _ratio(tp, tp + fp + fn),
            "predicted_pct": F.round(100 * (tp + fp) / total, 6), "truth_pct": F.round(100 * (tp + fn) / total, 6),
        }
    )


def micro_macro(counts: DataFrame) -> DataFrame:
    names = ("precision", "recall", "f1", "iou")
    macro = scores(counts).agg(*(F.round(F.avg(n), 6).alias(n) for n in names)).select(F.lit("macro").alias("level"), *names)
    micro = scores(counts.agg(*(F.sum(c).alias(c) for c in COUNTS))).select(F.lit("micro").alias("level"), *names)
    return macro.unionByName(micro)


def sweep(df: DataFrame, thresholds: list[float], *by: str) -> DataFrame:
    """Scores of each threshold. Pixels are first counted by how many thresholds they reach, so that the
    thresholds multiply a small table and not the pixels."""
    ordered = sorted(thresholds)
    reached = F.lit(0)
    for t in ordered:
        reached = reached + (F.col("p") >= F.lit(t).cast("float")).cast("int")
    cells = df.groupBy(*by, reached.alias("reached"), "truth").agg(F.count("*").alias("n"))
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(ordered, 1)))).alias("s")
    rows = cells.select(*by, "truth", "n", "reached", steps)
    pred, truth, n = F.col("reached") >= F.col("s.k"), F.col("truth"), F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(F.lit(0)))

    counts = rows.groupBy(*by, F.col("s.threshold").alias("threshold")).agg(
        total(pred & (truth == 1)).alias("tp"), total(pred & (truth == 0)).alias("fp"), total(~pred & (truth == 1)).alias("fn"), total(~pred & (truth == 0)).alias("tn")
    )
    return scores(counts)


def best_threshold(swept: DataFrame, *by: str) -> DataFrame:
    """Largest F1; of equals the higher threshold."""
    return swept.groupBy(*by).agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"))


def pooled_sweep(swept: DataFrame) -> DataFrame:
    return scores(swept.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in COUNTS)))


def best_by_each(pooled: DataFrame) -> DataFrame:
    best = pooled.agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("best_f1"), F.max_by("threshold", F.struct("iou", "threshold")).alias("best_iou"))
    return best.withColumn("same", F.col("best_f1") == F.col("best_iou"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    v = F.col("v")
    shares = [F.round(F.avg((v >= c / 100).cast("int")), 6).alias(f"at_{c}") for c in (25, 50, 75)]
    plain = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 6).alias("mean"), *shares)
    places = quantiles(df, [by], "v", [0.5, 0.9, 0.95, 0.99]).select(by, "q")
    return plain.join(places, by).select(by, "n", "low", "high", "mean", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))), "at_25", "at_50", "at_75")


def discrimination(df: DataFrame, by: str) -> DataFrame:
    """Tie-aware ROC-AUC and average precision; null where only one class is present. Equal scores are
    aggregated first, and sums run over range partitions."""
    return _discriminated(df.groupBy(by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")), [by])


def _discriminated(groups: DataFrame, by: list[str]) -> DataFrame:
    """AUC and average precision from (by, score, pos, neg), one row for each score."""
    rows = running_sums(groups, by, "score", ["pos", "neg"])
    whole = groups.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}"))
    rows = rows.alias("r").join(whole.alias("w"), on).select(*(F.col(f"r.{c}").alias(c) for c in by), "pos", "neg", "pos_upto", "neg_upto", "all_pos", "all_neg")
    below, tp = F.col("neg_upto") - F.col("neg"), F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    n = tp + F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    auc = F.sum(F.col("pos") * (below + F.col("neg") / 2)) / (F.max("all_pos") * F.max("all_neg"))
    return rows.groupBy(*by).agg(
        F.round(F.when(both, auc), 6).alias("auc"), F.round(F.when(both, F.sum(F.when(F.col("all_pos") > 0, F.col("pos") / F.col("all_pos") * (tp / n)))), 6).alias("average_precision")
    )


def histogram(df: DataFrame, by: str, bins: int) -> DataFrame:
    """Shares of equal bins on [0, 1] in each class; the last bin is closed."""
    counts = df.groupBy(by, F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(by, "bin", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6).alias("share"))


def error_zones(df: DataFrame, height: int, width: int, edge: int, patch: int, seam: int) -> DataFrame:
    """False positives near scene edges, near patch seams and off the seams."""
    y, x = F.col("y"), F.col("x")
    at_edge = F.least(y, x, height - 1 - y, width - 1 - x) < edge
    at_seam = F.least(y % patch, x % patch, patch - 1 - y % patch, patch - 1 - x % patch) < seam
    zones = F.array_compact(F.array(F.when(at_edge, "scene_edge"), F.when(at_seam, "patch_seam").otherwise("outside_seams")))
    fp = (F.col("pred") == 1) & (F.col("truth") == 0)
    whole = df.agg(F.count_if(fp).alias("all_fp"))
    rows = df.select("p", fp.alias("is_fp"), F.explode(zones).alias("zone")).groupBy("zone").agg(
        F.count("*").alias("n"), F.count_if("is_fp").alias("fp"), F.round(F.avg(F.col("p").cast("double")), 6).alias("mean_p")
    )
    return rows.join(F.broadcast(whole)).select(
        "zone", "n", "fp", F.round(F.col("fp") / F.col("n"), 6).alias("fp_rate"), F.round(F.try_divide("fp", "all_fp"), 6).alias("fp_share"), "mean_p"
    )


def by_patch(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy("scene_id", F.floor(F.col("y") / size).cast("int").alias("py"), F.floor(F.col("x") / size).cast("int").alias("px")).agg(
        F.round(100 * F.avg("pred"), 6).alias("predicted_pct"), F.round(100 * F.avg("truth"), 6).alias("truth_pct"), F.count_if((F.col("pred") == 1) & (F.col("truth") == 0)).alias("fp")
    )


def spectral(df: DataFrame, one: str, two: str) -> DataFrame:
    """Band values of both dates in each confusion class."""
    pred, truth, gap = F.col("pred"), F.col("truth"), F.abs(F.col(two) - F.col(one))
    kind = F.when((pred == 1) & (truth == 1), "TP").when(pred == 1, "FP").when(truth == 1, "FN").otherwise("TN")
    rows = df.select(kind.alias("class"), F.col(one).alias("one"), F.col(two).alias("two"), gap.alias("gap"))
    means = rows.groupBy("class").agg(F.round(F.avg("one"), 6).alias("mean_1"), F.round(F.avg("two"), 6).alias("mean_2"), F.round(F.avg("gap"), 6).alias("mean_abs"))
    return means.join(quantiles(rows, ["class"], "gap", [0.5]), "class").select("class", "mean_1", "mean_2", "mean_abs", F.round(F.col("q")[0], 6).alias("median_abs"))


def loss_parts(df: DataFrame, logit: str, truth: str, positive_weight: float, *by: str) -> DataFrame:
    """Sums of weighted cross-entropy and of soft-Dice terms; sums add up over batches, means do not."""
    z, t = F.col(logit), F.col(truth)
    weight = F.when(t == 1, positive_weight).otherwise(1.0)
    p = 1 / (1 + F.exp(-z))
    return df.groupBy(*by).agg(
        F.sum(weight * (F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z))))).alias("bce"), F.sum(weight).alias("w"),
        F.sum(p * t).alias("inter"), F.sum(p).alias("ps"), F.sum(t).alias("ts"),
    )


def loss(parts: DataFrame) -> DataFrame:
    total = parts.agg(*(F.sum(c).alias(c) for c in ("bce", "w", "inter", "ps", "ts")))
    bce, dice = F.col("bce") / F.col("w"), 1 - (2 * F.col("inter") + 1) / (F.col("ps") + F.col("ts") + 1)
    return total.select(F.round(bce, 6).alias("bce"), F.round(dice, 6).alias("dice"), F.round(bce + dice, 6).alias("loss"))


def class_balance(df: DataFrame, by: str) -> DataFrame:
    changed, unchanged = F.count_if(F.col("truth") == 1), F.count_if(F.col("truth") == 0)
    return df.rollup(by).agg(changed.alias("changed"), unchanged.alias("unchanged"), F.round(F.try_divide(unchanged, changed), 6).alias("positive_weight"))


def mask_domain(df: DataFrame, by: str) -> DataFrame:
    """Values of a mask that must be 1 or 2."""
    return df.groupBy(by).agg(F.count_if(~F.col("v").isin(1, 2)).alias("bad"), F.count_if(F.col("v") == 2).alias("changed"))


def compare(base: DataFrame, new: DataFrame, by: str, name: str) -> DataFrame:
    a, b = base.select(by, F.col(name).alias("a")), new.select(by, F.col(name).alias("b"))
    gain = F.col("b") - F.col("a")
    return a.join(b, by).select(by, F.round(gain, 6).alias("absolute"), F.round(F.when(F.col("a") != 0, 100 * gain / F.col("a")), 4).alias("relative_pct"))


#: F1 of the screening baseline and the gain on it that a run with low recall must show.
BASELINE_F1, BASELINE_GAIN = 0.0930390328, 0.10


def screening_stop(epochs: DataFrame) -> DataFrame:
    """First epoch, from the third on, at which a run is given up."""
    low = (F.col("precision") < 0.20) & (F.col("f1") < 0.25)
    stuck = (F.col("recall") < 0.25) & (F.col("f1") < BASELINE_F1 + BASELINE_GAIN)
    return epochs.filter((F.col("epoch") >= 3) & (low | stuck)).groupBy("run").agg(F.min("epoch").alias("stop_epoch"))


def best_checkpoint(epochs: DataFrame) -> DataFrame:
    """Least loss of each run, the earliest of equals."""
    return epochs.groupBy("run").agg(F.min(F.struct("loss", "epoch")).alias("b")).select("run", "b.epoch", "b.loss")


def evaluation_job(df: DataFrame, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """Evaluation of each location, each fold and all together: (sweep, summary).

    ``df``: fold, location, p, truth. Pixels are read once and counted by score; grouping sets add those counts up for the
    three levels, and everything else comes from that table. The sweep has the scores at every threshold. The summary has the
    best thresholds by F1 and by IoU and whether they agree (ties go to the higher), AUC and average precision, the
    mean score of both classes, and for folds and all together the mean F1 at the best threshold over the locations.
    """
    counted = df.groupBy("fold", "location", F.col("p").alias("score")).agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg"))
    rolled = counted.sparkSession.sql(
        "SELECT CASE grouping_id() WHEN 0 THEN 'location' WHEN 2 THEN 'fold' ELSE 'pooled' END AS level, fold, location, score, sum(pos) AS pos, sum(neg) AS neg "
        "FROM {counted} GROUP BY GROUPING SETS ((fold, location, score), (fold, score), (score))", counted=counted,
    )
    rolled = stage(rolled, "score-counts")
    by = ["level", "fold", "location"]

    reached = sum((F.col("score") >= F.lit(t).cast("float")).cast("int") for t in sorted(thresholds))
    steps = F.array(*(F.lit(float(t)) for t in sorted(thresholds)))
    few = rolled.groupBy(*by, F.coalesce(reached, F.lit(0)).alias("reached")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    at = few.select(*by, "pos", "neg", "reached", F.posexplode(steps).alias("i", "threshold"))
    hit = F.col("reached") > F.col("i")
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    swept = stage(scores(at.groupBy(*by, "threshold").agg(total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("pos", ~hit).alias("fn"), total("neg", ~hit).alias("tn"))), "swept")

    best = [F.max_by("threshold", F.struct(c, "threshold")).alias(f"best_{c}") for c in ("f1", "iou")]
    chosen = swept.groupBy(*by).agg(*best, F.max("f1").alias("f1")).withColumn("agree", F.col("best_f1") == F.col("best_iou"))
    means = rolled.groupBy(*by).agg(*(F.round(F.try_divide(F.sum(F.col("score").cast("double") * F.col(c)), F.sum(c)), 6).alias(f"mean_{c}") for c in ("pos", "neg")))
    pooled = swept.filter("level = 'pooled'").agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"))
    local = swept.filter("level = 'location'").join(F.broadcast(pooled), "threshold").select("fold", "f1")
    macro = local.groupBy("fold").agg(F.avg("f1").alias("macro")).select(F.lit("fold").alias("level"), "fold", "macro").unionByName(
        local.agg(F.avg("f1").alias("macro")).select(F.lit("pooled").alias("level"), F.lit(None).cast(df.schema["fold"].dataType).alias("fold"), "macro")
    )
    summary = chosen
    for other in (means, _discriminated(rolled.filter("score IS NOT NULL"), by)):
        on = F.lit(True)
        for c in by:
            on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        summary = summary.alias("a").join(other.alias("b"), on, "left").select("a.*", *(f"b.{c}" for c in other.columns if c not in by))
    on = (F.col("a.level") == F.col("b.level")) & F.col("a.fold").eqNullSafe(F.col("b.fold"))
    summary = summary.alias("a").join(macro.alias("b"), on, "left").select("a.*", F.round("b.macro", 6).alias("macro_f1"))
    return swept, summary
