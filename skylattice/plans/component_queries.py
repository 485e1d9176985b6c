"""Queries of connected components and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, pixels
from ..operators import calibration, change, components
from . import views
from .pixel_queries import _SAR, _geo, _sar
from .registry import query
from .views import PX, PX2, SIDE

T = 0.85
_VALID = "scl NOT IN (0,1,3,8,9,10,11)"


def reach(mask: str, near: str = "abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1", name: str = "") -> str:
    """Labels of the pixels of ``mask`` as recursive SQL: the views mask, lab and comp (with suffix ``name``)."""
    return f"""mask{name} AS ({mask}), reach{name} AS (SELECT scene_id, y, x, y * 50 + x AS root FROM mask{name} UNION
 SELECT m.scene_id, m.y, m.x, r.root FROM reach{name} r JOIN mask{name} m ON m.scene_id = r.scene_id AND {near}),
 lab{name} AS (SELECT scene_id, y, x, min(root) AS root FROM reach{name} GROUP BY ALL),
 comp{name} AS (SELECT *, (dense_rank() OVER (PARTITION BY scene_id ORDER BY root))::INT AS component_id FROM lab{name})"""


_COMP = f"WITH RECURSIVE {PX}, {reach(f'SELECT scene_id, y, x FROM px WHERE p >= {T}::FLOAT')}"
_BIG = "big AS (SELECT c.* FROM comp c JOIN (SELECT scene_id, root FROM comp GROUP BY ALL HAVING count(*) >= 4) k USING (scene_id, root))"


def mask(spark, sf, t: float = T):
    p = views.px(spark, sf)
    return p.filter(F.col("p") >= F.lit(t).cast("float")).select("scene_id", "y", "x")


def labelled(spark, sf):
    return components.numbered(components.label(mask(spark, sf)))


def _pixels(spark, sf):
    return views.px(spark, sf).select("scene_id", "y", "x", "p", pixels.scl_valid(F.col("scl")).alias("valid"))


@query("F1", f"{_COMP} SELECT scene_id, y, x, component_id FROM comp")
def f1(spark, sf):
    return labelled(spark, sf).select("scene_id", "y", "x", "component_id")


@query("E4", f"{_COMP} SELECT scene_id, component_id, min(y * 50 + x)::INT AS first_pixel FROM comp GROUP BY ALL")
def e4(spark, sf):
    return labelled(spark, sf).groupBy("scene_id", "component_id").agg(F.min(F.col("y") * SIDE + F.col("x")).alias("first_pixel"))


@query("F2", f"{_COMP}, {_BIG} SELECT scene_id, y, x FROM big")
def f2(spark, sf):
    return components.drop_small(components.label(mask(spark, sf)), 4).select("scene_id", "y", "x")


_D9 = "(VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx)"
_IN = "BETWEEN 0 AND 49"


def _close(source: str) -> str:
    return f"""grown AS (SELECT DISTINCT scene_id, y + dy AS y, x + dx AS x FROM {source}, {_D9} WHERE y + dy {_IN} AND x + dx {_IN}),
 closed AS (SELECT scene_id, y, x FROM (SELECT scene_id, y + dy AS y, x + dx AS x FROM grown, {_D9}) WHERE y {_IN} AND x {_IN} GROUP BY ALL HAVING count(*) = 9)"""


@query("F3", f"WITH {PX}, mask AS (SELECT scene_id, y, x FROM px WHERE p >= {T}::FLOAT), {_close('mask')} SELECT * FROM closed")
def f3(spark, sf):
    return components.closing(mask(spark, sf), SIDE, SIDE)


_CHAIN = f"WITH RECURSIVE {PX}, {reach(f'SELECT scene_id, y, x FROM px WHERE p >= {T}::FLOAT AND {_VALID}')}, {_BIG}, {_close('big')}, final AS (SELECT scene_id, y, x FROM closed JOIN px USING (scene_id, y, x) WHERE {_VALID})"


@query("F4", f"{_CHAIN} SELECT scene_id, y, x FROM final")
def f4(spark, sf):
    return components.postprocess(_pixels(spark, sf), T, 4, True, SIDE, SIDE)


@query("D5", f"""{_COMP}, a AS (SELECT scene_id, count(*) AS area FROM comp GROUP BY scene_id, root), t AS (SELECT scene_id, count(*) FILTER ({_VALID}) AS valid FROM px GROUP BY scene_id)
 SELECT t.scene_id, any_value(valid) AS valid, coalesce(sum(area), 0)::BIGINT AS changed, round(coalesce(100 * sum(area) / any_value(valid), 0), 6) AS percent, count(area) AS components, coalesce(max(area), 0) AS largest,
 coalesce(quantile_cont(area, 0.5), 0) AS median, coalesce(array_to_string(list_slice(list(area ORDER BY area DESC) FILTER (area IS NOT NULL), 1, 10), ','), '') AS top_areas FROM t LEFT JOIN a USING (scene_id) GROUP BY t.scene_id""")
def d5(spark, sf):
    return components.component_statistics(components.label(mask(spark, sf)), _pixels(spark, sf))


_CAND = f"""{_COMP}, cand AS (SELECT scene_id, component_id, count(*) AS area, min(x) AS xmin, min(y) AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y,
 round(avg(p::DOUBLE), 6) AS mean_p, round(max(p::DOUBLE), 6) AS max_p, round(quantile_cont(p::DOUBLE, 0.5), 6) AS median_p, round(quantile_cont(p::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(p::DOUBLE, 0.95), 6) AS p95,
 round(avg((p >= 0.9::FLOAT)::INT), 6) AS over_threshold, min(least(y, x, 49 - y, 49 - x)) AS edge_distance, min(least(y, x, 49 - y, 49 - x)) = 0 AS touches_edge, round(avg(({_VALID})::INT), 6) AS valid_fraction
 FROM comp JOIN px USING (scene_id, y, x) GROUP BY scene_id, component_id)"""
_JUDGED = f"{_CAND}, judged AS (SELECT *, array_to_string(list_filter([CASE WHEN touches_edge THEN 'image_edge' END, CASE WHEN valid_fraction < 0.3 THEN 'valid_fraction' END], lambda r: r IS NOT NULL), ',') AS reasons FROM cand), j AS (SELECT *, reasons = '' AS retained FROM judged)"


def _candidates(spark, sf):
    return components.candidates(labelled(spark, sf), _pixels(spark, sf), 0.9, SIDE, SIDE)


@query("D6", f"{_CAND} SELECT * FROM cand")
def d6(spark, sf):
    return _candidates(spark, sf)


def _judged(spark, sf):
    return components.rejected(_candidates(spark, sf), True, 0.3)


@query("D7", f"{_JUDGED} SELECT scene_id, count(*) FILTER (NOT retained) AS removed_components, count(*) FILTER (retained) AS retained_components, coalesce(sum(area) FILTER (NOT retained), 0)::BIGINT AS removed_pixels, coalesce(sum(area) FILTER (retained), 0)::BIGINT AS retained_pixels FROM j GROUP BY scene_id")
def d7(spark, sf):
    return components.accounting(_judged(spark, sf))


@query("D8", f"WITH {PX} SELECT scene_id, count(*) FILTER (p >= {T}::FLOAT) AS changed, (count(*) FILTER (p >= {T}::FLOAT) * 100)::DOUBLE AS area_m2 FROM px GROUP BY scene_id")
def d8(spark, sf):
    counts = views.px(spark, sf).groupBy("scene_id").agg(F.count_if(F.col("p") >= F.lit(T).cast("float")).alias("changed"))
    return counts.withColumn("area_m2", F.col("changed") * geo.pixel_area(_geo(), F.lit(1.0)))


_RANK = "CASE WHEN retained THEN (row_number() OVER (PARTITION BY scene_id, retained ORDER BY round(mean_p * ln(1 + area), 6) DESC, component_id))::INT END"


def _ranked(spark, sf):
    return components.ranked(_judged(spark, sf), F.round(F.col("mean_p") * F.log1p("area"), 6))


@query("E1", f"{_JUDGED} SELECT scene_id, component_id, retained, reasons, {_RANK} AS rank FROM j")
def e1(spark, sf):
    return _ranked(spark, sf).select("scene_id", "component_id", "retained", "reasons", "rank")


@query("E13", f"{_JUDGED}, r AS (SELECT *, {_RANK} AS rank FROM j) SELECT scene_id, coalesce(max(component_id) FILTER (component_id = 3), arg_min(component_id, rank)) AS component_id FROM r WHERE retained GROUP BY scene_id")
def e13(spark, sf):
    return change.primary(_ranked(spark, sf).filter("retained"), preferred=3)


@query("C14", f"{_COMP}, e AS (SELECT scene_id, component_id, unnest(['h', 'h', 'v', 'v']) AS kind, unnest([y, y + 1, y, y]) AS ey, unnest([x, x, x, x + 1]) AS ex FROM comp) SELECT scene_id, component_id, kind, ey, ex FROM e GROUP BY ALL HAVING count(*) = 1")
def c14(spark, sf):
    return components.outlines(labelled(spark, sf))


_C13 = f"""sar AS (SELECT scene_id, y, x, {_SAR} AS s FROM px), hits AS (SELECT c.scene_id, c.component_id, round(avg(sar.s), 6) AS mean_sar, any_value(c.mean_p) AS mean_p, any_value(c.valid_fraction) AS q
 FROM cand c JOIN sar ON sar.scene_id = c.scene_id AND sar.y >= c.ymin AND sar.y < c.ymax AND sar.x >= c.xmin AND sar.x < c.xmax GROUP BY c.scene_id, c.component_id)"""


def _evidence(spark, sf):
    sar = views.px(spark, sf).select("scene_id", "y", "x", _sar().alias("evidence"))
    return change.evidence_inside(_candidates(spark, sf), sar, block=16)


@query("C13", f"{_CAND}, {_C13} SELECT scene_id, component_id, mean_sar FROM hits")
def c13(spark, sf):
    return _evidence(spark, sf).select("scene_id", "component_id", "mean_sar")


@query("L4", f"""{_CAND}, {_C13} SELECT scene_id, component_id, mean_sar, round_even(100 * (0.45 * mean_p + 0.25 * mean_sar + 0.15 * (2 * mean_p * mean_sar / (mean_p + mean_sar + 1e-6)) + 0.15 * q), 1) AS score,
 CASE WHEN mean_p >= 0.70 AND mean_sar >= 0.55 THEN 'HIGH AGREEMENT' WHEN mean_sar >= 0.55 THEN 'SAR-ONLY' WHEN mean_p >= 0.70 THEN 'OPTICAL-ONLY' ELSE 'NO STRONG EVIDENCE' END AS label, mean_p >= 0.70 AND mean_sar >= 0.55 AS corroborated FROM hits""")
def l4(spark, sf):
    return change.verify(_evidence(spark, sf))


@query("D23", f"WITH RECURSIVE {PX}, {reach(f'SELECT scene_id, y, x FROM px WHERE p >= {T}::FLOAT AND truth = 0')}, a AS (SELECT scene_id, count(*) AS area FROM lab GROUP BY scene_id, root), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY area DESC) AS i FROM a) SELECT scene_id, count(*) AS components, max(area) AS largest, round(coalesce(sum(area) FILTER (i <= 10), 0) / sum(area), 6) AS top10_share, count(*) FILTER (area >= 16) AS big FROM k GROUP BY scene_id")
def d23(spark, sf):
    wrong = views.px(spark, sf).filter((F.col("p") >= F.lit(T).cast("float")) & (F.col("truth") == 0)).select("scene_id", "y", "x")
    return change.error_components(components.label(wrong), 16)


@query("F6", f"""WITH {PX}, fp AS (SELECT scene_id, y, x FROM px WHERE p >= {T}::FLOAT AND truth = 0), tr AS (SELECT scene_id, y, x FROM px WHERE truth = 1),
 d AS (SELECT fp.scene_id, fp.y, fp.x, min((fp.y - tr.y) * (fp.y - tr.y) + (fp.x - tr.x) * (fp.x - tr.x)) AS d2 FROM fp LEFT JOIN tr ON tr.scene_id = fp.scene_id GROUP BY ALL)
 SELECT scene_id, CASE WHEN d2 <= 4 THEN 'near' WHEN d2 <= 64 THEN 'far' ELSE 'beyond' END AS band, count(*) AS n FROM d GROUP BY ALL""")
def f6(spark, sf):
    p = views.px(spark, sf)
    wrong = p.filter((F.col("p") >= F.lit(T).cast("float")) & (F.col("truth") == 0)).select("scene_id", "y", "x")
    truth = p.filter("truth = 1").select("scene_id", "y", "x")
    return components.distance_bands(wrong, truth, 2, 8)


_F7 = f"""WITH RECURSIVE {PX}, {PX2}, dist AS (SELECT a.scene_id, a.y, a.x, (abs(a.b04 - b.b04) + abs(a.b08 - b.b08) + abs(a.scl - b.scl) * 20) / 3 AS d FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x),
 blk AS (SELECT scene_id, (y // 10)::INT AS y, (x // 10)::INT AS x FROM dist WHERE d > 30 GROUP BY ALL HAVING count(*) / 100 > 0.3), {reach('SELECT * FROM blk', 'abs(m.y - r.y) + abs(m.x - r.x) <= 1')},
 k AS (SELECT scene_id, root, count(*) AS blocks, min(y) AS t, min(x) AS l, max(y) AS b, max(x) AS r FROM lab GROUP BY ALL), f7 AS (SELECT scene_id, (row_number() OVER (PARTITION BY scene_id ORDER BY blocks DESC, root))::INT AS rank, blocks, t AS "top", l AS "left", b AS "bottom", r AS "right" FROM k QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY blocks DESC, root) <= 5)"""


def _distances(spark, sf):
    a, b = (v.select("scene_id", "y", "x", "b04", "b08", (F.col("scl") * 20).alias("shade")) for v in (views.px(spark, sf), views.px2(spark, sf)))
    return change.pixel_distance(a, b, ("b04", "b08", "shade"))


@query("F7", f"{_F7} SELECT * FROM f7")
def f7(spark, sf):
    return change.block_clusters(_distances(spark, sf))


@query("F7_report", f"""{_F7}, days AS (SELECT event_id // 2500 AS scene_id, abs(round((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 86400))::INT AS days FROM events GROUP BY ALL), n AS (SELECT scene_id, count(*) AS regions FROM f7 GROUP BY ALL),
 s AS (SELECT scene_id, round(avg((d > 30)::INT) * 100, 1) AS delta, round(100 - avg(d) / 255 * 100, 1) AS similarity FROM dist GROUP BY ALL) SELECT scene_id, delta, similarity, days, coalesce(regions, 0) AS regions FROM s LEFT JOIN days USING (scene_id) LEFT JOIN n USING (scene_id)""")
def f7_report(spark, sf):
    dates = views.read(spark, sf, "events").groupBy(F.expr("event_id div 2500").alias("scene_id")).agg(F.min("ts").alias("before"), F.max("ts").alias("after"))
    distances = _distances(spark, sf)
    return change.visual_report(distances, change.block_clusters(distances), dates)


_STEP3 = "(VALUES (-1), (0), (1)) s(d)"
_LEVELS = ", ".join(f"({k}, {t}::DOUBLE)" for k, t in enumerate(calibration.THRESHOLDS))
_AREAS = ", ".join(f"({a})" for a in calibration.AREAS)
_D15 = f"""WITH RECURSIVE {PX}, th(k, t) AS (VALUES {_LEVELS}), ar(area) AS (VALUES {_AREAS}), lev AS (SELECT k, t, scene_id, y, x FROM px, th WHERE p >= t::FLOAT),
 cc(k, scene_id, y, x, root) USING KEY (k, scene_id, y, x) AS (SELECT k, scene_id, y, x, y * 50 + x FROM lev
  UNION SELECT m.k, m.scene_id, m.y, m.x, min(c.root) FROM (SELECT k, scene_id, y + dy AS y, x + dx AS x, root FROM cc, {_D9}) c JOIN recurring.cc m ON m.k = c.k AND m.scene_id = c.scene_id AND m.y = c.y AND m.x = c.x WHERE c.root < m.root GROUP BY ALL),
 kept AS (SELECT c.k, area, c.scene_id, y, x FROM cc c JOIN (SELECT k, scene_id, root, count(*) AS n FROM cc GROUP BY ALL) USING (k, scene_id, root) JOIN ar ON n >= area),
 g1 AS (SELECT DISTINCT k, area, scene_id, y + d AS y, x FROM kept, {_STEP3} WHERE y + d {_IN}), g2 AS (SELECT DISTINCT k, area, scene_id, y, x + d AS x FROM g1, {_STEP3} WHERE x + d {_IN}),
 e1 AS (SELECT k, area, scene_id, y, x FROM (SELECT k, area, scene_id, y + d AS y, x FROM g2, {_STEP3}) WHERE y {_IN} GROUP BY ALL HAVING count(*) = 3), e2 AS (SELECT k, area, scene_id, y, x FROM (SELECT k, area, scene_id, y, x + d AS x FROM e1, {_STEP3}) WHERE x {_IN} GROUP BY ALL HAVING count(*) = 3),
 preds AS (SELECT 'none' AS morphology, * FROM kept UNION ALL SELECT 'closing', * FROM e2), t AS (SELECT count(*) AS n, sum(truth)::BIGINT AS pos FROM px),
 c AS (SELECT k, area, morphology, count(*) FILTER (truth = 1) AS tp, count(*) FILTER (truth = 0) AS fp FROM preds JOIN px USING (scene_id, y, x) GROUP BY ALL),
 g AS (SELECT th.t AS threshold, ar.area::INT AS area, m.morphology, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, pos - coalesce(tp, 0) AS fn, n - pos - coalesce(fp, 0) AS tn, round(2 * coalesce(tp, 0) / (pos + coalesce(tp, 0) + coalesce(fp, 0)), 6) AS f1
  FROM th, ar, (VALUES ('none'), ('closing')) m(morphology), t LEFT JOIN c ON c.k = th.k AND c.area = ar.area AND c.morphology = m.morphology)"""


@query("D15", f"{_D15} SELECT * FROM g")
def d15(spark, sf):
    """All 160 settings."""
    return calibration.calibration_grid(views.px(spark, sf), height=SIDE, width=SIDE)


@query("D16", f"{_D15} SELECT threshold, area, morphology, f1 FROM g ORDER BY f1 DESC, (morphology = 'none') DESC, area, threshold DESC LIMIT 1")
def d16(spark, sf):
    return change.choose(calibration.calibration_grid(views.px(spark, sf), height=SIDE, width=SIDE))


_LOGIT = "round(1 / (1 + exp(-(abs(b.b04 - a.b04) / 50 - 2))), 6)"


@query("L2", f"WITH {PX}, {PX2} SELECT a.scene_id, a.y, a.x, CASE WHEN a.{_VALID} THEN {_LOGIT} ELSE 0 END AS p, a.{_VALID} AS valid FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x")
def l2(spark, sf):
    a, b = (v.select("scene_id", "y", "x", "b04", "scl") for v in (views.px(spark, sf), views.px2(spark, sf)))
    return change.score_pairs(a, b, "b04")


@query("L6", f"""{_JUDGED}, full_mask AS (SELECT c.scene_id, y, x, retained FROM comp c JOIN j USING (scene_id, component_id)), t AS (SELECT sum(truth) AS pos FROM px),
 m AS (SELECT 'all' AS variant, count(*) FILTER (truth = 1) AS tp, count(*) FILTER (truth = 0) AS fp FROM full_mask JOIN px USING (scene_id, y, x) UNION ALL
 SELECT 'without_edge', count(*) FILTER (truth = 1), count(*) FILTER (truth = 0) FROM full_mask JOIN px USING (scene_id, y, x) WHERE retained)
 SELECT variant, tp, fp, (pos - tp)::BIGINT AS fn, round(2 * tp / (2 * tp + fp + (pos - tp)), 6) AS f1 FROM m, t""")
def l6(spark, sf):
    return change.edge_ablation(labelled(spark, sf), _judged(spark, sf), views.px(spark, sf))
