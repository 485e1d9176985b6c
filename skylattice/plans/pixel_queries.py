"""Queries of pixel algebra and of grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, pixels
from ..operators import raster
from . import views
from .registry import query
from .views import PX, PX2, SIDE

KEY = ("scene_id", "y", "x")

def _geo():
    return F.array(*map(F.lit, (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0)))


def sql(select: str, *views_sql: str) -> str:
    return f"WITH {', '.join(views_sql or (PX,))} {select}"


@query("A8", sql("SELECT scene_id, y, x, max(CASE WHEN band = 'B04' THEN v END) AS \"B04\", max(CASE WHEN band = 'B08' THEN v END) AS \"B08\" FROM (SELECT scene_id, y, x, 'B04' AS band, b04 AS v FROM px UNION ALL SELECT scene_id, y, x, 'B08', b08 FROM px) GROUP BY ALL"))
def a8(spark, sf):
    p = views.px(spark, sf)
    long = p.select(*KEY, F.expr("stack(2, 'B04', b04, 'B08', b08) AS (band, value)"))
    return raster.stack_bands(long, ["B04", "B08"])


@query("B16", sql("SELECT scene_id, y, x, scl NOT IN (0,1,3,8,9,10,11) AS valid FROM px"))
def b16(spark, sf):
    return views.px(spark, sf).select(*KEY, pixels.scl_valid(F.col("scl")).alias("valid"))


@query("B17", sql("SELECT scene_id, y, x, qa & 63 = 0 AS valid FROM px"))
def b17(spark, sf):
    return views.px(spark, sf).select(*KEY, pixels.qa_valid(F.col("qa")).alias("valid"))


@query("B18", sql("SELECT scene_id, y, x, CASE WHEN scene_id % 2 = 0 THEN scl NOT IN (0,1,3,8,9,10,11) ELSE qa & 63 = 0 END AS valid FROM px"))
def b18(spark, sf):
    even = F.col("scene_id") % 2 == 0
    sensor, quality = F.when(even, "sentinel-2").otherwise("landsat"), F.when(even, F.col("scl")).otherwise(F.col("qa"))
    return views.px(spark, sf).select(*KEY, pixels.quality_valid(sensor, quality).alias("valid"))


@query("B19", sql("SELECT scene_id, y, x, CASE WHEN scl NOT IN (0,1,3,8,9,10,11) THEN b04 END AS b04, CASE WHEN scl NOT IN (0,1,3,8,9,10,11) THEN b08 END AS b08 FROM px"))
def b19(spark, sf):
    valid = pixels.scl_valid(F.col("scl"))
    return views.px(spark, sf).select(*KEY, *(pixels.masked(F.col(b), valid).alias(b) for b in ("b04", "b08")))


@query("B20", sql("""SELECT scene_id, y, x, sensor, round((CASE sensor WHEN 'sentinel-2' THEN dn * 1e-4 WHEN 'landsat' THEN CASE WHEN dn <> 0 THEN dn * 2.75e-5 - 0.2 END ELSE CASE WHEN dn <> 0 THEN dn END END)::FLOAT::DOUBLE, 6) AS value
 FROM (SELECT *, floor(b04 * 20)::BIGINT AS dn, ['sentinel-2', 'landsat', 'sentinel-1'][(scene_id % 3 + 1)::INT] AS sensor FROM px)"""))
def b20(spark, sf):
    sensor = F.element_at(F.array(F.lit("sentinel-2"), F.lit("landsat"), F.lit("sentinel-1")), (F.col("scene_id") % 3 + 1).cast("int"))
    p = views.px(spark, sf).select(*KEY, sensor.alias("sensor"), F.floor(F.col("b04") * 20).alias("dn"))
    return p.select(*KEY, "sensor", F.round(pixels.reflectance(F.col("sensor"), F.col("dn")).cast("double"), 6).alias("value"))


@query("B21", sql("SELECT scene_id, y, x, round(CASE WHEN qa & 63 <> 0 THEN least(greatest(b04 / 100, 0.0), 1.0) * 2 - 1 ELSE 0 END, 6) AS value FROM px"))
def b21(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.model_input(F.col("b04"), 100.0, ~pixels.qa_valid(F.col("qa"))), 6).alias("value"))


@query("B22", sql("SELECT scene_id, y, x, round(floor(b04) % 256 / 127.5 - 1, 6) AS value FROM px"))
def b22(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.rgb_input(F.floor(F.col("b04")) % 256), 6).alias("value"))


@query("B23", sql("SELECT scene_id, y, x, round_even(least(greatest(b04 / 100, 0.0), 1.0) * 255, 0)::SMALLINT AS v FROM px"))
def b23(spark, sf):
    return views.px(spark, sf).select(*KEY, pixels.to_uint8(F.col("b04") / 100).alias("v"))


@query("B24", sql("SELECT scene_id, y, x, round(CASE WHEN b08 + b04 <> 0 THEN (b08 - b04) / (b08 + b04) END, 6) AS ndvi FROM px"))
def b24(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.ndvi(F.col("b04"), F.col("b08")), 6).alias("ndvi"))


@query("B25", sql("SELECT scene_id, y, x, (p >= 0.85::FLOAT AND scl NOT IN (0,1,3,8,9,10,11))::TINYINT AS mask FROM px"))
def b25(spark, sf):
    return views.px(spark, sf).select(*KEY, pixels.threshold_mask(F.col("p"), 0.85, pixels.scl_valid(F.col("scl"))).alias("mask"))


_VV, _VH = "b04 / 1000", "b08 / 4000"
_SAR = f"(0.65 * least(greatest((10 * log10(greatest({_VV}, 1e-7)) + 25) / 22, 0.0), 1.0) + 0.35 * least(greatest((10 * log10(greatest({_VH}, 1e-7)) + 32) / 22, 0.0), 1.0))"


def _sar():
    return pixels.sar_evidence(F.col("b04") / 1000, F.col("b08") / 4000)


@query("B26", sql(f"SELECT scene_id, y, x, round({_SAR}, 6) AS evidence FROM px"))
def b26(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(_sar(), 6).alias("evidence"))


_OS = f"SELECT scene_id, y, x, p::DOUBLE AS o, {_SAR} AS s, b08 / 700 AS q FROM px"
_CAT = "CASE WHEN o >= 0.70 AND s >= 0.55 THEN 3 WHEN o >= 0.70 THEN 2 WHEN s >= 0.55 THEN 1 ELSE 0 END"


def _fused(spark, sf):
    return views.px(spark, sf).select(*KEY, F.col("p").cast("double").alias("o"), _sar().alias("s"), (F.col("b08") / 700).alias("q"))


@query("B27", sql(f"SELECT scene_id, y, x, round(2 * o * s / (o + s + 1e-6), 6) AS agreement, {_CAT} AS category FROM ({_OS})"))
def b27(spark, sf):
    o, s = F.col("o"), F.col("s")
    return _fused(spark, sf).select(*KEY, F.round(pixels.agreement(o, s), 6).alias("agreement"), pixels.agreement_category(o, s).alias("category"))


@query("B28", sql(f"""SELECT scene_id, y, x, CASE {_CAT} WHEN 3 THEN 'HIGH AGREEMENT' WHEN 1 THEN 'SAR-ONLY' WHEN 2 THEN 'OPTICAL-ONLY' ELSE 'NO STRONG EVIDENCE' END AS label,
 round_even(100 * (0.45 * o + 0.25 * s + 0.15 * (2 * o * s / (o + s + 1e-6)) + 0.15 * q), 1) AS score FROM ({_OS})"""))
def b28(spark, sf):
    o, s, q = F.col("o"), F.col("s"), F.col("q")
    return _fused(spark, sf).select(*KEY, pixels.fusion_label(o, s).alias("label"), pixels.fusion_score(o, s, q).alias("score"))


@query("B29", sql("SELECT scene_id, y, x, round(ln(q / (1 - q)), 6) AS logit FROM (SELECT *, least(greatest(p::DOUBLE, 1e-7), 1 - 1e-7) AS q FROM px)"))
def b29(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.logit(F.col("p").cast("double")), 6).alias("logit"))


@query("B30", sql("SELECT scene_id, y, x, round((b08 - b04) / (abs(b04) + abs(b08) + 1e-8), 6) AS nd FROM px"))
def b30(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.normalised_difference(F.col("b04"), F.col("b08")), 6).alias("nd"))


RAMP = [(0.0, (0, 0, 0, 0)), (0.5, (255, 200, 0, 160)), (1.0, (255, 0, 0, 255))]


def _ramp_sql(k: int) -> str:
    low, mid, high = (s[1][k] for s in RAMP)
    return f"(CASE WHEN p <= 0 THEN {low} WHEN p < 0.5 THEN round_even({low} + ({mid - low}) * (v - 0.0) / 0.5, 0) WHEN p < 1.0 THEN round_even({mid} + ({high - mid}) * (v - 0.5) / 0.5, 0) ELSE {high} END)::INT"


@query("B31", sql(f"SELECT scene_id, y, x, {', '.join(f'{_ramp_sql(k)} AS {n}' for k, n in enumerate('rgba'))} FROM (SELECT *, p::DOUBLE AS v FROM px)"))
def b31(spark, sf):
    return views.px(spark, sf).select(*KEY, pixels.colour_ramp(F.col("p").cast("double"), RAMP).alias("c")).select(*KEY, "c.*")


@query("B35", sql("SELECT scene_id, y, x, (10.0 * (x + 0.5) + 500000)::DOUBLE AS mx, (-10.0 * (y + 0.5) + 4600000)::DOUBLE AS my FROM px"))
def b35(spark, sf):
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    return views.px(spark, sf).select(*KEY, geo.map_x(_geo(), x, y).alias("mx"), geo.map_y(_geo(), x, y).alias("my"))


@query("B36", sql("SELECT scene_id, CASE WHEN scene_id % 3 <> 0 THEN 100.0::DOUBLE END AS area_m2 FROM (SELECT DISTINCT scene_id FROM px)"))
def b36(spark, sf):
    unit = F.when(F.col("scene_id") % 3 != 0, 1.0)
    return views.px(spark, sf).select("scene_id").distinct().select("scene_id", geo.pixel_area(_geo(), unit).alias("area_m2"))


@query("B39", sql("SELECT scene_id, y, x, round(1 / (1 + exp(b04 / 100 - b08 / 100)), 6) AS p_change FROM px"))
def b39(spark, sf):
    return views.px(spark, sf).select(*KEY, F.round(pixels.softmax2(F.col("b04") / 100, F.col("b08") / 100), 6).alias("p_change"))


@query("C7", sql("""SELECT a.scene_id, a.y, a.x, round(CASE WHEN b.b08 + b.b04 <> 0 THEN (b.b08 - b.b04) / (b.b08 + b.b04) END - CASE WHEN a.b08 + a.b04 <> 0 THEN (a.b08 - a.b04) / (a.b08 + a.b04) END, 6) AS delta
 FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x""", PX, PX2))
def c7(spark, sf):
    a, b = (v.select(*KEY, pixels.ndvi(F.col("b04"), F.col("b08")).alias("ndvi")) for v in (views.px(spark, sf), views.px2(spark, sf)))
    return raster.aligned(a, b, ["ndvi"]).select(*KEY, F.round(F.col("ndvi_2") - F.col("ndvi_1"), 6).alias("delta"))


@query("C9", sql("""SELECT g.scene_id, g.gy AS y, g.gx AS x, coalesce(p.scl, 0) AS scl FROM (SELECT s.scene_id, gy::INT AS gy, gx::INT AS gx FROM (SELECT DISTINCT scene_id FROM px) s, range(0, 30) a(gy), range(0, 30) b(gx)) g
 LEFT JOIN px p ON p.scene_id = g.scene_id AND p.y = floor((g.gy + 0.5) * 2) AND p.x = floor((g.gx + 0.5) * 2)"""))
def c9(spark, sf):
    p = views.px(spark, sf)
    return raster.nearest(p.select(*KEY, "scl"), p.select("scene_id").distinct(), 30, 30, (2.0, 0.0, 0.0, 0.0, 2.0, 0.0), "scl")


@query("C10", sql("""SELECT scene_id, oy AS y, ox AS x, round(sum(w * b04), 6) AS value FROM (
 SELECT scene_id, oy, ox, (CASE WHEN dy = 0 THEN 1 - fy ELSE fy END) * (CASE WHEN dx = 0 THEN 1 - fx ELSE fx END) AS w, least(greatest(iy + dy, 0), 49) AS sy, least(greatest(ix + dx, 0), 49) AS sx FROM (
  SELECT s.scene_id, oy::INT AS oy, ox::INT AS ox, floor(greatest((oy + 0.5) * 2.5 - 0.5, 0)) AS iy, floor(greatest((ox + 0.5) * 2.5 - 0.5, 0)) AS ix, greatest((oy + 0.5) * 2.5 - 0.5, 0) - floor(greatest((oy + 0.5) * 2.5 - 0.5, 0)) AS fy, greatest((ox + 0.5) * 2.5 - 0.5, 0) - floor(greatest((ox + 0.5) * 2.5 - 0.5, 0)) AS fx
  FROM (SELECT DISTINCT scene_id FROM px) s, range(0, 20) a(oy), range(0, 20) b(ox)), (VALUES (0), (1)) d1(dy), (VALUES (0), (1)) d2(dx)) t
 JOIN px ON px.scene_id = t.scene_id AND px.y = t.sy AND px.x = t.sx GROUP BY ALL""".replace("SELECT scene_id, oy AS y", "SELECT t.scene_id, oy AS y")))
def c10(spark, sf):
    p = views.px(spark, sf)
    return raster.bilinear(p.select(*KEY, F.col("b04").alias("value")), p.select("scene_id").distinct(), SIDE, SIDE, 20, 20).withColumn("value", F.round("value", 6))


@query("C11", sql("SELECT scene_id, (y // 5)::INT AS y, (x // 5)::INT AS x, round(avg(b04), 6) AS value FROM px GROUP BY ALL"))
def c11(spark, sf):
    return raster.average_down(views.px(spark, sf), 5, "b04").select(*KEY, F.round("value", 6).alias("value"))


@query("C12", sql("SELECT scene_id, y, x, b04 FROM px WHERE x BETWEEN 10 AND 19 AND y BETWEEN 5 AND 24"))
def c12(spark, sf):
    box = (500100.0, 4599750.0, 500200.0, 4599950.0)
    return raster.crop(views.px(spark, sf).select(*KEY, "b04"), (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), box)


_GRID = "grid AS (SELECT scene_id, count(*) AS n, 50 AS width, (max(y) + 1)::INT AS height, CASE WHEN scene_id % 4 = 1 THEN 'EPSG:32644' ELSE 'EPSG:32643' END AS crs FROM px GROUP BY scene_id)"


def _grid(spark, sf):
    return views.px(spark, sf).groupBy("scene_id").agg(F.lit(50).alias("width"), (F.max("y") + 1).alias("height")).withColumn(
        "crs", F.when(F.col("scene_id") % 4 == 1, "EPSG:32644").otherwise("EPSG:32643")
    )


@query("C23", f"WITH {PX}, {_GRID} SELECT a.scene_id, unnest(['width', 'height', 'crs']) AS check_name, unnest([CASE WHEN a.width = r.width THEN 'PASS' ELSE 'FAIL' END, CASE WHEN a.height = r.height THEN 'PASS' ELSE 'FAIL' END, CASE WHEN a.crs = r.crs THEN 'PASS' ELSE 'FAIL' END]) AS verdict FROM grid a, grid r WHERE r.scene_id = 0")
def c23(spark, sf):
    g = _grid(spark, sf)
    return raster.grid_checks(g, g.filter("scene_id = 0"), "scene_id", ["width", "height", "crs"])


@query("C25", sql("SELECT a.scene_id, round(max(abs(a.p::DOUBLE - b.p::DOUBLE)), 6) AS worst FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x GROUP BY a.scene_id", PX, PX2))
def c25(spark, sf):
    both = raster.aligned(views.px(spark, sf).select(*KEY, "p"), views.px2(spark, sf).select(*KEY, "p"), ["p"])
    gap = F.abs(F.col("p_1").cast("double") - F.col("p_2").cast("double"))
    return both.groupBy("scene_id").agg(F.round(F.max(gap), 6).alias("worst"))


@query("D1", sql("SELECT scene_id, count(*) AS total, count(*) FILTER (scl NOT IN (0,1,3,8,9,10,11)) AS valid, count(*) FILTER (scl IN (0,1,3,8,9,10,11)) AS masked, round(count(*) FILTER (scl NOT IN (0,1,3,8,9,10,11)) / count(*), 6) AS valid_fraction FROM px GROUP BY scene_id"))
def d1(spark, sf):
    return raster.mask_statistics(views.px(spark, sf).select("scene_id", pixels.scl_valid(F.col("scl")).alias("valid")))


_CLEAR = "CASE WHEN scl NOT IN (0,1,3,8,9,10,11) THEN b04 END"


@query("D2", sql(f"""SELECT w.scene_id, min({_CLEAR}) AS low, max({_CLEAR}) AS high, round(avg({_CLEAR}), 6) AS mean, count(*) AS n, round(count({_CLEAR}) / count(*), 6) AS valid_fraction FROM
 (SELECT DISTINCT scene_id FROM px) w, (VALUES (0), (15), (30)) a(y0), (VALUES (0), (15), (30)) b(x0), px WHERE px.scene_id = w.scene_id AND px.y >= y0 AND px.y < y0 + 20 AND px.x >= x0 AND px.x < x0 + 20 GROUP BY w.scene_id"""))
def d2(spark, sf):
    value = F.when(pixels.scl_valid(F.col("scl")), F.col("b04")).alias("value")
    return raster.sampled_statistics(views.px(spark, sf).select(*KEY, value), SIDE, SIDE, 20, 3)


_TILES = """SELECT scene_id, (y // 16)::INT AS ty, (x // 16)::INT AS tx, round(count(*) FILTER (scl NOT IN (0,1,3,8,9,10,11)) / 256, 6) AS valid_fraction FROM px GROUP BY ALL"""


@query("D3", sql(f"SELECT scene_id, (ty * 4 + tx)::INT AS tile_no, valid_fraction, valid_fraction >= 0.3 AS accepted FROM ({_TILES})"))
def d3(spark, sf):
    p = views.px(spark, sf).select(*KEY, pixels.scl_valid(F.col("scl")).alias("valid"))
    return raster.tile_statistics(p, 16, SIDE, 0.3)


@query("D4", sql("SELECT scene_id, round(least(avg((scl NOT IN (0,1,3,8,9,10,11))::INT), avg((qa & 3 = 0)::INT)), 6) AS valid_fraction FROM px GROUP BY scene_id"))
def d4(spark, sf):
    share = [F.avg(pixels.scl_valid(F.col("scl")).cast("int")), F.avg((F.col("qa").bitwiseAND(3) == 0).cast("int"))]
    return views.px(spark, sf).groupBy("scene_id").agg(F.round(F.least(*share), 6).alias("valid_fraction"))


@query("D9", sql(f"SELECT scene_id, count(*) FILTER (c = 3) AS both_strong, count(*) FILTER (c = 2) AS optical_only, count(*) FILTER (c = 1) AS sar_only, count(*) FILTER (c = 0) AS neither FROM (SELECT scene_id, {_CAT} AS c FROM ({_OS})) GROUP BY scene_id"))
def d9(spark, sf):
    c = pixels.agreement_category(F.col("o"), F.col("s"))
    names = ((3, "both_strong"), (2, "optical_only"), (1, "sar_only"), (0, "neither"))
    return _fused(spark, sf).select("scene_id", c.alias("c")).groupBy("scene_id").agg(*(F.count_if(F.col("c") == k).alias(n) for k, n in names))


@query("D10", sql("""SELECT scene_id, count(d) AS finite, count(*) - count(d) AS invalid, round(min(d), 6) AS low, round(max(d), 6) AS high, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median,
 round(100 * avg((d < 0)::INT), 6) AS decrease_pct, round(100 * avg((d > 0)::INT), 6) AS increase_pct, round(100 * avg((d <= -0.1)::INT), 6) AS strong_decrease_pct, round(100 * avg((d >= 0.1)::INT), 6) AS strong_increase_pct
 FROM (SELECT a.scene_id, CASE WHEN b.b08 + b.b04 <> 0 THEN (b.b08 - b.b04) / (b.b08 + b.b04) END - CASE WHEN a.b08 + a.b04 <> 0 THEN (a.b08 - a.b04) / (a.b08 + a.b04) END AS d FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x) GROUP BY scene_id""", PX, PX2))
def d10(spark, sf):
    a, b = (v.select(*KEY, pixels.ndvi(F.col("b04"), F.col("b08")).alias("ndvi")) for v in (views.px(spark, sf), views.px2(spark, sf)))
    return raster.delta_report(raster.aligned(a, b, ["ndvi"]).select("scene_id", (F.col("ndvi_2") - F.col("ndvi_1")).alias("d")))


@query("D37", sql("SELECT scene_id, round(quantile_cont(b04, 0.98), 6) AS p98, round(quantile_cont(abs(b08 - b04), 0.98), 6) AS p98_abs, round(quantile_cont(b04, 0.99), 6) AS p99 FROM px GROUP BY scene_id"))
def d37(spark, sf):
    return views.px(spark, sf).groupBy("scene_id").agg(
        F.round(F.percentile("b04", 0.98), 6).alias("p98"), F.round(F.percentile(F.abs(F.col("b08") - F.col("b04")), 0.98), 6).alias("p98_abs"),
        F.round(F.percentile("b04", 0.99), 6).alias("p99"),
    )


@query("D38", sql("SELECT scene_id, count(*) FILTER (p < 0 OR p > 1) AS out_of_range, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (truth NOT IN (0, 1)) AS not_binary FROM px GROUP BY scene_id"))
def d38(spark, sf):
    p = F.col("p")
    return views.px(spark, sf).groupBy("scene_id").agg(
        F.count_if((p < 0) | (p > 1)).alias("out_of_range"), F.count_if(p.isNull() | F.isnan(p)).alias("missing"), F.count_if(~F.col("truth").isin(0, 1)).alias("not_binary")
    )


@query("H11", sql("SELECT scene_id, y * 50 + x AS i, ((y * 50 + x) // 50)::INT AS y_back, ((y * 50 + x) % 50)::INT AS x_back FROM px"))
def h11(spark, sf):
    p = views.px(spark, sf).select("scene_id", (F.col("y") * SIDE + F.col("x")).alias("i"))
    return p.select("scene_id", "i", F.expr("i div 50").cast("int").alias("y_back"), F.pmod("i", F.lit(SIDE)).cast("int").alias("x_back"))
