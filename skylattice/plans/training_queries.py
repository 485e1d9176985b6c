"""Queries of training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import raster, training
from . import views
from .registry import query
from .views import PX, SIDE

_FULL = "g AS (SELECT DISTINCT scene_id, 50 AS height, 50 AS width FROM px)"
_PATCH = "p AS (SELECT scene_id, unnest([0, 16, 32, 48]) AS top FROM g), pt AS (SELECT scene_id, top, unnest([0, 16, 32, 48]) AS \"left\" FROM p)"


def _grids(spark, sf):
    """All scenes have this size, also those that lack pixels."""
    return views.px(spark, sf).select("scene_id").distinct().select("scene_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))


@query("J1", f"WITH {PX}, {_FULL}, {_PATCH} SELECT * FROM pt")
def j1(spark, sf):
    return training.patch_grid(_grids(spark, sf), 16, 16)


_EXTRACT = f"""WITH {PX}, {_FULL}, {_PATCH}, cell AS (SELECT pt.*, i::INT AS i, j::INT AS j, CASE WHEN top + i < 50 THEN top + i ELSE 98 - top - i END AS y, CASE WHEN "left" + j < 50 THEN "left" + j ELSE 98 - "left" - j END AS x, top + i < 50 AND "left" + j < 50 AS valid FROM pt, range(0, 16) a(i), range(0, 16) b(j)),
 ex AS (SELECT c.scene_id, top, "left", i, j, b04, CASE WHEN valid THEN coalesce(truth, 0) ELSE 0 END AS label, valid AND truth IS NOT NULL AS valid FROM cell c LEFT JOIN px ON px.scene_id = c.scene_id AND px.y = c.y AND px.x = c.x)"""


def _patches(spark, sf):
    return training.extract(_grids(spark, sf), views.px(spark, sf).select("scene_id", "y", "x", "b04", "truth"), 16, 16, "b04", "truth")


@query("J2", f"{_EXTRACT} SELECT * FROM ex")
def j2(spark, sf):
    return _patches(spark, sf)


@query("J3", f'{_EXTRACT} SELECT scene_id, top, "left", (CASE k WHEN 0 THEN i WHEN 1 THEN i WHEN 2 THEN 15 - i WHEN 3 THEN 15 - j WHEN 4 THEN 15 - i ELSE j END)::INT AS ni, (CASE k WHEN 0 THEN j WHEN 1 THEN 15 - j WHEN 2 THEN j WHEN 3 THEN i WHEN 4 THEN 15 - j ELSE 15 - i END)::INT AS nj, b04, label FROM (SELECT *, (scene_id + top // 16 + "left" // 16) % 6 AS k FROM ex)')
def j3(spark, sf):
    choice = (F.col("scene_id") + F.expr("top div 16") + F.expr("left div 16")) % 6
    return training.augment(_patches(spark, sf), 16, choice).select("scene_id", "top", "left", "ni", "nj", "b04", "label")


@query("J4", f"WITH {PX}, c AS (SELECT scene_id, y, x, scl NOT IN (0,1,3,8,9,10,11) AS v FROM px), t AS (SELECT scene_id, top, \"left\", count(*) FILTER (v) AS n FROM c, (VALUES (0), (8), (16), (24), (32), (40)) a(top), (VALUES (0), (8), (16), (24), (32), (40)) b(\"left\") WHERE y >= top AND y < top + 16 AND x >= \"left\" AND x < \"left\" + 16 GROUP BY ALL) SELECT scene_id, top, \"left\", round(n / 256, 6) AS valid_fraction FROM t WHERE n / 256 >= 0.3")
def j4(spark, sf):
    p = views.px(spark, sf).select("scene_id", "y", "x", pixels.scl_valid(F.col("scl")).alias("valid"))
    return raster.overlapping_tiles(p, 16, 8, SIDE, 0.3)


@query("J8", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F') WHERE i IN (SELECT floor(k * (SELECT count(*) - 1 FROM orders WHERE o_orderstatus = 'F') / 8)::BIGINT FROM range(0, 9) r(k))")
def j8(spark, sf):
    return training.evenly(views.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 9)


@query("J9", f"WITH {PX}, {_FULL} SELECT scene_id, unnest([16, 25, 50]) AS stride, unnest([16, 4, 1])::BIGINT AS patches FROM g")
def j9(spark, sf):
    grids = _grids(spark, sf)
    one = lambda s, p: training.patch_grid(grids, p, s).groupBy("scene_id").agg(F.lit(s).alias("stride"), F.count("*").alias("patches"))
    return one(16, 16).union(one(25, 25)).union(one(50, 50))


_BANDS = "bd AS (SELECT scene_id, 1 AS date, 'b04' AS band, y, x FROM px UNION ALL SELECT scene_id, 1, 'b08', y, x FROM px UNION ALL SELECT scene_id, 2, 'b04', y, x FROM px UNION ALL SELECT scene_id, 2, 'b08', y, x FROM px WHERE scene_id % 3 <> 1 AND NOT (scene_id % 5 = 2 AND y > 40)), g AS (SELECT scene_id, date, band, max(y) + 1 AS height, max(x) + 1 AS width FROM bd GROUP BY ALL), m AS (SELECT scene_id, max(y) + 1 AS mh, max(x) + 1 AS mw FROM px WHERE scene_id % 7 <> 6 GROUP BY ALL)"


@query("J5", f"WITH {PX}, {_BANDS}, d AS (SELECT scene_id, date, count(DISTINCT band) AS n, min(height) AS h0, max(height) AS h1, min(width) AS w0, max(width) AS w1 FROM g GROUP BY ALL), l AS (SELECT scene_id, min(n) AS least_bands, max(n) AS most_bands, count(*) AS dates, max(h1) AS height, max(w1) AS width, min(h0) = max(h1) AND min(w0) = max(w1) AS same_grid FROM d GROUP BY scene_id) SELECT scene_id AS location, least_bands, most_bands, dates, height, width, same_grid, coalesce(height = mh AND width = mw, false) AS mask_ok, least_bands = 2 AND dates = 2 AND same_grid AND coalesce(height = mh AND width = mw, false) AS complete FROM l LEFT JOIN m USING (scene_id)")
def j5(spark, sf):
    """Two bands at two dates; some locations lack a band, some a part of one, some the mask."""
    px = views.px(spark, sf)
    cut = "scene_id % 3 <> 1 AND NOT (scene_id % 5 = 2 AND y > 40)"
    parts = [(1, "b04", px), (1, "b08", px), (2, "b04", px), (2, "b08", px.filter(cut))]
    size = [(F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")]
    grids = [p.groupBy(F.col("scene_id").alias("location")).agg(*size).select("location", F.lit(d).alias("date"), F.lit(b).alias("band"), "height", "width") for d, b, p in parts]
    masks = px.filter("scene_id % 7 <> 6").groupBy(F.col("scene_id").alias("location")).agg(*size)
    return training.inventory(grids[0].union(grids[1]).union(grids[2]).union(grids[3]), masks, 2, 2)


@query("J7", f"WITH {PX} SELECT scene_id, 'supervised' AS kind, sum(truth)::BIGINT AS changed FROM px WHERE scene_id % 2 = 0 GROUP BY scene_id UNION ALL SELECT scene_id, 'unlabelled', NULL FROM px WHERE scene_id % 2 = 1 GROUP BY scene_id")
def j7(spark, sf):
    p = views.px(spark, sf)
    known = p.filter("scene_id % 2 = 0").groupBy("scene_id").agg(F.lit("supervised").alias("kind"), F.sum("truth").alias("changed"))
    rest = p.filter("scene_id % 2 = 1").select("scene_id").distinct().withColumn("kind", F.lit("unlabelled"))
    return known.unionByName(rest, allowMissingColumns=True)


@query("C22", f"WITH {PX} SELECT scene_id, count(*) AS covered, count(*) = 2500 AS complete, 0::BIGINT AS overlapping FROM px GROUP BY scene_id")
def c22(spark, sf):
    patches = views.px(spark, sf).select(
        "scene_id", F.expr("(y div 16) * 16").alias("top"), F.expr("(x div 16) * 16").alias("left"), (F.col("y") % 16).alias("i"), (F.col("x") % 16).alias("j"), "p"
    )
    return raster.mosaic_checks(patches, SIDE, SIDE)
