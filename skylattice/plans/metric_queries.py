"""Queries of evaluation: confusion, sweeps, curves, distributions, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import metrics
from . import views
from .registry import query
from .views import PX

T = [round(0.05 * k, 2) for k in range(1, 20)]
_T = ", ".join(f"({t}::FLOAT)" for t in T)
_CONF = "count(*) FILTER (pred = 1 AND truth = 1) AS tp, count(*) FILTER (pred = 1 AND truth = 0) AS fp, count(*) FILTER (pred = 0 AND truth = 1) AS fn, count(*) FILTER (pred = 0 AND truth = 0) AS tn"
_SCORES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou,
 round(100 * (tp + fp) / (tp + fp + fn + tn), 6) AS predicted_pct, round(100 * (tp + fn) / (tp + fp + fn + tn), 6) AS truth_pct"""
_AT = "thr AS (SELECT *, (p >= 0.85::FLOAT)::INT AS pred FROM px)"
_CONFUSION = f"WITH {PX}, {_AT}, cm AS (SELECT scene_id, {_CONF} FROM thr GROUP BY scene_id)"
_SWEEP = f"{PX}, sweep AS (SELECT scene_id, round(t::DOUBLE, 2) AS threshold, {_CONF} FROM (SELECT px.*, t, (p >= t)::INT AS pred FROM px, (VALUES {_T}) v(t)) GROUP BY ALL), swept AS (SELECT scene_id, threshold, tp, fp, fn, tn, {_SCORES} FROM sweep)"


def at_threshold(spark, sf, t: float = 0.85):
    return views.px(spark, sf).withColumn("pred", pixels.threshold_mask(F.col("p"), t).cast("int"))


@query("D11", f"{_CONFUSION} SELECT scene_id, tp, fp, fn, tn, {_SCORES} FROM cm")
def d11(spark, sf):
    return metrics.scores(metrics.confusion(at_threshold(spark, sf), "scene_id"))


@query("D12", f"""{_CONFUSION}, s AS (SELECT scene_id, tp, fp, fn, tn, {_SCORES} FROM cm)
SELECT 'macro' AS level, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(iou), 6) AS iou FROM s UNION ALL
SELECT 'micro', precision, recall, f1, iou FROM (SELECT tp, fp, fn, tn, {_SCORES} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cm))""")
def d12(spark, sf):
    return metrics.micro_macro(metrics.confusion(at_threshold(spark, sf), "scene_id"))


@query("D13", f"WITH {_SWEEP} SELECT * FROM swept")
def d13(spark, sf):
    return metrics.sweep(views.px(spark, sf), T, "scene_id")


@query("D14", f"WITH {_SWEEP} SELECT scene_id, arg_max(threshold, f1 * 1000 + threshold / 1000) AS threshold FROM swept GROUP BY scene_id")
def d14(spark, sf):
    return metrics.best_threshold(metrics.sweep(views.px(spark, sf), T, "scene_id"), "scene_id")


@query("D17", f"WITH {_SWEEP}, pooled AS (SELECT threshold, tp, fp, fn, tn, {_SCORES} FROM (SELECT threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM sweep GROUP BY threshold)) SELECT arg_max(threshold, f1 * 1000 + threshold / 1000) AS best_f1, arg_max(threshold, iou * 1000 + threshold / 1000) AS best_iou, arg_max(threshold, f1 * 1000 + threshold / 1000) = arg_max(threshold, iou * 1000 + threshold / 1000) AS same FROM pooled")
def d17(spark, sf):
    return metrics.best_by_each(metrics.pooled_sweep(metrics.sweep(views.px(spark, sf), T, "scene_id")))


@query("D18", f"""WITH {PX} SELECT truth, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90,
 round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(avg((v >= 0.25)::INT), 6) AS at_25, round(avg((v >= 0.5)::INT), 6) AS at_50, round(avg((v >= 0.75)::INT), 6) AS at_75 FROM (SELECT truth, p::DOUBLE AS v FROM px) GROUP BY truth""")
def d18(spark, sf):
    return metrics.distribution(views.px(spark, sf).select("truth", F.col("p").cast("double").alias("v")), "truth")


@query("D19", f"""WITH {PX}, g AS (SELECT scene_id, p AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM px GROUP BY ALL),
 r AS (SELECT *, sum(neg) OVER (PARTITION BY scene_id ORDER BY s) - neg AS below, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n, sum(pos) OVER (PARTITION BY scene_id) AS all_pos, sum(neg) OVER (PARTITION BY scene_id) AS all_neg FROM g WINDOW w AS (PARTITION BY scene_id ORDER BY s DESC))
 SELECT scene_id, round(CASE WHEN any_value(all_pos) > 0 AND any_value(all_neg) > 0 THEN sum(pos * (below + neg / 2)) / (any_value(all_pos) * any_value(all_neg)) END, 6) AS auc,
 round(CASE WHEN any_value(all_pos) > 0 AND any_value(all_neg) > 0 THEN sum(pos / all_pos * (tp / n)) END, 6) AS average_precision FROM r GROUP BY scene_id""")
def d19(spark, sf):
    return metrics.discrimination(views.px(spark, sf).select("scene_id", F.col("p").alias("score"), F.col("truth").alias("label")), "scene_id")


@query("D20", f"WITH {PX} SELECT truth, least(floor(p::DOUBLE * 100), 99)::INT AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM px GROUP BY truth, 2")
def d20(spark, sf):
    return metrics.histogram(views.px(spark, sf).select("truth", F.col("p").cast("double").alias("v")), "truth", 100)


_ZONES = "unnest(list_filter([CASE WHEN least(y, x, 49 - y, 49 - x) < 8 THEN 'scene_edge' END, CASE WHEN least(y % 16, x % 16, 15 - y % 16, 15 - x % 16) < 2 THEN 'patch_seam' ELSE 'outside_seams' END], lambda z: z IS NOT NULL))"


@query("D21", f"""WITH {PX}, {_AT} SELECT zone, count(*) AS n, count(*) FILTER (pred = 1 AND truth = 0) AS fp, round(count(*) FILTER (pred = 1 AND truth = 0) / count(*), 6) AS fp_rate,
 round(count(*) FILTER (pred = 1 AND truth = 0) / (SELECT count(*) FROM thr WHERE pred = 1 AND truth = 0), 6) AS fp_share, round(avg(p::DOUBLE), 6) AS mean_p FROM (SELECT *, {_ZONES} AS zone FROM thr) GROUP BY zone""")
def d21(spark, sf):
    return metrics.error_zones(at_threshold(spark, sf), views.SIDE, views.SIDE, edge=8, patch=16, seam=2)


@query("D22", f"WITH {PX}, {_AT} SELECT scene_id, (y // 16)::INT AS py, (x // 16)::INT AS px, round(100 * avg(pred), 6) AS predicted_pct, round(100 * avg(truth), 6) AS truth_pct, count(*) FILTER (pred = 1 AND truth = 0) AS fp FROM thr GROUP BY ALL")
def d22(spark, sf):
    return metrics.by_patch(at_threshold(spark, sf), 16)


@query("D24", f"WITH {PX}, {_AT} SELECT CASE WHEN pred = 1 AND truth = 1 THEN 'TP' WHEN pred = 1 THEN 'FP' WHEN truth = 1 THEN 'FN' ELSE 'TN' END AS class, round(avg(b04), 6) AS mean_1, round(avg(b08), 6) AS mean_2, round(avg(abs(b08 - b04)), 6) AS mean_abs, round(quantile_cont(abs(b08 - b04), 0.5), 6) AS median_abs FROM thr GROUP BY 1")
def d24(spark, sf):
    return metrics.spectral(at_threshold(spark, sf), "b04", "b08")


_LOSS = """SELECT scene_id, sum(CASE WHEN truth = 1 THEN 4.0 ELSE 1.0 END * (greatest(z, 0) - z * truth + ln(1 + exp(-abs(z))))) AS bce, sum(CASE WHEN truth = 1 THEN 4.0 ELSE 1.0 END) AS w,
 sum(s * truth) AS inter, sum(s) AS ps, sum(truth) AS ts FROM (SELECT *, b04 / 100 - 1 AS z, 1 / (1 + exp(-(b04 / 100 - 1))) AS s FROM px WHERE scl NOT IN (0,1,3,8,9,10,11)) GROUP BY scene_id"""


@query("D25", f"WITH {PX}, c AS ({_LOSS}) SELECT round(sum(bce) / sum(w), 6) AS bce, round(1 - (2 * sum(inter) + 1) / (sum(ps) + sum(ts) + 1), 6) AS dice, round(sum(bce) / sum(w) + 1 - (2 * sum(inter) + 1) / (sum(ps) + sum(ts) + 1), 6) AS loss FROM c")
def d25(spark, sf):
    p = views.px(spark, sf).filter(pixels.scl_valid(F.col("scl"))).withColumn("z", F.col("b04") / 100 - 1)
    return metrics.loss(metrics.loss_parts(p, "z", "truth", 4.0, "scene_id"))


@query("D26", f"WITH {PX} SELECT scene_id, count(*) FILTER (truth = 1) AS changed, count(*) FILTER (truth = 0) AS unchanged, round(count(*) FILTER (truth = 0) / count(*) FILTER (truth = 1), 6) AS positive_weight FROM px GROUP BY ROLLUP (scene_id)")
def d26(spark, sf):
    return metrics.class_balance(views.px(spark, sf), "scene_id")


@query("D27", f"WITH {PX} SELECT scene_id, count(*) FILTER (truth + 1 NOT IN (1, 2)) AS bad, count(*) FILTER (truth + 1 = 2) AS changed FROM px GROUP BY scene_id")
def d27(spark, sf):
    return metrics.mask_domain(views.px(spark, sf).select("scene_id", (F.col("truth") + 1).alias("v")), "scene_id")


@query("C20", f"""{_CONFUSION}, b AS (SELECT scene_id, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cm),
 c2 AS (SELECT scene_id, {_CONF} FROM (SELECT *, (p >= 0.6::FLOAT)::INT AS pred FROM px) GROUP BY scene_id), k AS (SELECT scene_id, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c2)
 SELECT scene_id, round(round(k.f1, 6) - round(b.f1, 6), 6) AS absolute, round(CASE WHEN round(b.f1, 6) <> 0 THEN 100 * (round(k.f1, 6) - round(b.f1, 6)) / round(b.f1, 6) END, 4) AS relative_pct FROM b JOIN k USING (scene_id)""")
def c20(spark, sf):
    base, new = (metrics.scores(metrics.confusion(at_threshold(spark, sf, t), "scene_id")) for t in (0.85, 0.6))
    return metrics.compare(base, new, "scene_id", "f1")


_EPOCHS = """epochs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, (value % 10) / 10 AS precision, (value % 7) / 7 AS recall, value % 3 AS loss FROM events)"""


def _epochs(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return views.read(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(order).alias("epoch"), (v % 10 / 10).alias("precision"), (v % 7 / 7).alias("recall"), (v % 3).alias("loss")
    )


@query("E10", f"""WITH {_EPOCHS}, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM epochs)
 SELECT run, min(epoch) AS stop_epoch FROM f WHERE epoch >= 3 AND ((precision < 0.2 AND f1 < 0.25) OR (recall < 0.25 AND f1 < 0.0930390328 + 0.1)) GROUP BY run""")
def e10(spark, sf):
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return metrics.screening_stop(_epochs(spark, sf).withColumn("f1", f1)).withColumn("stop_epoch", F.col("stop_epoch").cast("long"))


@query("E11", f"WITH {_EPOCHS} SELECT run, epoch, loss FROM epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, epoch) = 1")
def e11(spark, sf):
    return metrics.best_checkpoint(_epochs(spark, sf)).withColumn("epoch", F.col("epoch").cast("long"))


_EVAL = f"""WITH {PX}, e AS (SELECT scene_id % 3 AS fold, scene_id AS location, p, truth FROM px), th AS (SELECT t, round(t::DOUBLE, 2) AS threshold FROM (VALUES {_T}) v(t)),
 lv AS (SELECT 'location' AS level, fold, location, p, truth FROM e UNION ALL SELECT 'fold', fold, NULL, p, truth FROM e UNION ALL SELECT 'pooled', NULL, NULL, p, truth FROM e),
 sw AS (SELECT level, fold, location, threshold, count(*) FILTER (p >= t AND truth = 1) AS tp, count(*) FILTER (p >= t AND truth = 0) AS fp, count(*) FILTER (p < t AND truth = 1) AS fn, count(*) FILTER (p < t AND truth = 0) AS tn FROM lv, th GROUP BY ALL),
 swept AS (SELECT level, fold, location, threshold, tp, fp, fn, tn, {_SCORES} FROM sw)"""


@query("L5", f"{_EVAL} SELECT * FROM swept")
def l5(spark, sf):
    """The sweep of the evaluation: locations, folds, pooled."""
    return metrics.evaluation_job(_folded(spark, sf), T)[0]


def _folded(spark, sf):
    return views.px(spark, sf).select((F.col("scene_id") % 3).alias("fold"), F.col("scene_id").alias("location"), "p", "truth")


@query("L5_summary", f"""{_EVAL}, b AS (SELECT level, fold, location, arg_max(threshold, f1 * 1000 + threshold / 1000) AS best_f1, arg_max(threshold, iou * 1000 + threshold / 1000) AS best_iou, max(f1) AS f1 FROM swept GROUP BY ALL),
 m AS (SELECT level, fold, location, round(avg(p::DOUBLE) FILTER (truth = 1), 6) AS mean_pos, round(avg(p::DOUBLE) FILTER (truth = 0), 6) AS mean_neg FROM lv GROUP BY ALL),
 g AS (SELECT level, fold, location, p AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM lv GROUP BY ALL),
 r AS (SELECT *, sum(neg) OVER up - neg AS below, sum(pos) OVER down AS tp, sum(pos + neg) OVER down AS n, sum(pos) OVER (PARTITION BY level, fold, location) AS all_pos, sum(neg) OVER (PARTITION BY level, fold, location) AS all_neg FROM g WINDOW up AS (PARTITION BY level, fold, location ORDER BY s), down AS (PARTITION BY level, fold, location ORDER BY s DESC)),
 d AS (SELECT level, fold, location, round(CASE WHEN any_value(all_pos) > 0 AND any_value(all_neg) > 0 THEN sum(pos * (below + neg / 2)) / (any_value(all_pos) * any_value(all_neg)) END, 6) AS auc, round(CASE WHEN any_value(all_pos) > 0 AND any_value(all_neg) > 0 THEN sum(pos / all_pos * (tp / n)) END, 6) AS average_precision FROM r GROUP BY ALL),
 loc AS (SELECT fold, f1 FROM swept WHERE level = 'location' AND threshold = (SELECT best_f1 FROM b WHERE level = 'pooled')),
 mac AS (SELECT 'fold' AS level, fold, avg(f1) AS macro FROM loc GROUP BY fold UNION ALL SELECT 'pooled', NULL, avg(f1) FROM loc)
 SELECT b.level, b.fold, b.location, best_f1, best_iou, f1, best_f1 = best_iou AS agree, mean_pos, mean_neg, auc, average_precision, round(macro, 6) AS macro_f1 FROM b JOIN m ON m.level = b.level AND m.fold IS NOT DISTINCT FROM b.fold AND m.location IS NOT DISTINCT FROM b.location JOIN d ON d.level = b.level AND d.fold IS NOT DISTINCT FROM b.fold AND d.location IS NOT DISTINCT FROM b.location LEFT JOIN mac ON mac.level = b.level AND mac.fold IS NOT DISTINCT FROM b.fold""")
def l5_summary(spark, sf):
    return metrics.evaluation_job(_folded(spark, sf), T)[1]
