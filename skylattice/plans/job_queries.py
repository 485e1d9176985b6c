"""Queries of arrays, block filters, files, streams and whole jobs."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geo, pixels
from ..operators import analysis, catalog, change, clipping, components, embedding, focal, raster
from ..sources import aoi, arrays, manifests, sinks, stac
from ..storage import Store, new_path
from ..streaming import jobs
from . import views
from .catalog_queries import utm_sql
from .component_queries import _RANK, _VALID, T, _close, mask, reach
from .pixel_queries import _geo
from .ledger_queries import _CHAIN
from .registry import query
from .views import LEDGER, PX, PX2, SCENES, SIDE


def _written(df, label: str, kind: str = "json") -> str:
    path = new_path(df.sparkSession, label)
    getattr(df.write, kind)(path)
    return path


@query("A1", f"WITH {SCENES} SELECT scene_id, sensor, cloud AS cloud_cover, downloaded FROM scenes")
def a1(spark, sf):
    rows = views.scenes(spark, sf).select("scene_id", "sensor", F.col("cloud").alias("cloud_cover"), "downloaded")
    schema = "scene_id string, sensor string, cloud_cover double, downloaded boolean"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(_written(rows, "scene-catalog"))


@query("A2", f"WITH {SCENES} SELECT 'T' || scene_no AS tile_id, scene_id AS source_scene_id, [xmin, ymin, xmax, ymax]::VARCHAR AS bounds FROM scenes")
def a2(spark, sf):
    rows = views.scenes(spark, sf).select(
        F.concat(F.lit("T"), F.col("scene_no").cast("string")).alias("tile_id"), F.col("scene_id").alias("source_scene_id"), F.array("xmin", "ymin", "xmax", "ymax").alias("bounds")
    )
    back = spark.read.schema(manifests.TILE).option("mode", "FAILFAST").json(_written(rows, "tile-catalog")).orderBy("tile_id")
    return back.select("tile_id", "source_scene_id", F.concat(F.lit("["), F.array_join(F.transform("bounds", lambda x: x.cast("string")), ", "), F.lit("]")).alias("bounds"))


@query("A7", """SELECT o_custkey AS source, o_orderkey AS tile, CASE WHEN o_orderkey % 5 = 0 THEN 'absolute' WHEN o_orderkey % 5 < 3 THEN 'below' ELSE 'beside' END AS how FROM orders WHERE o_orderkey % 5 <> 4""")
def a7(spark, sf):
    """Paths that are absolute, below the archive, only beside the manifest, or nowhere."""
    name, key = F.concat(F.col("o_orderkey").cast("string"), F.lit(".tif")), F.col("o_orderkey") % 5
    path = F.when(key == 0, F.concat(F.lit("/absolute/"), name)).otherwise(F.concat(F.lit("tiles/"), name))
    orders = views.read(spark, sf, "orders")
    rows = orders.groupBy(F.col("o_custkey").cast("string").alias("source")).agg(F.collect_list(F.struct(path.alias("path"))).alias("tiles"))
    root = _written(rows, "manifests")
    held = F.when(key == 0, path).when(key < 3, F.concat(F.lit("/archive/"), path)).when(key == 3, F.concat(F.lit(root + "/"), name))
    found = manifests.resolve_tiles(manifests.read_manifests(spark, root, "*.json"), orders.select(held.alias("file")).filter("file IS NOT NULL"), "/archive")
    return found.select(F.col("source").cast("long").alias("source"), F.regexp_extract("path", r"(\d+)[.]tif$", 1).cast("long").alias("tile"), "how")


@query("A12", "SELECT 'C' || c_custkey AS id FROM customer")
def a12(spark, sf):
    names = views.read(spark, sf, "customer").select(F.expr("c_custkey div 40").alias("g"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("n"))
    lines = names.groupBy("g").agg(F.array_join(F.collect_list("n"), ", ").alias("value")).select("value")
    return manifests.read_roster(spark, _written(lines, "roster", "text"))


@query("A13", "SELECT c_custkey AS id, strftime(TIMESTAMP '2015-01-01' + INTERVAL 1 DAY * c_custkey, '%Y%m%d') AS t1, strftime(TIMESTAMP '2015-01-01' + INTERVAL 1 DAY * (c_custkey + 30), '%Y%m%d') AS t2 FROM customer")
def a13(spark, sf):
    day = lambda k: F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c_custkey") + k).cast("int")), "yyyyMMdd")
    file = F.concat(F.lit("places/"), F.col("c_custkey").cast("string"), F.lit("/dates.txt"))
    texts = views.read(spark, sf, "customer").select(file.alias("file"), F.concat(F.lit("date_1: "), day(0), F.lit("\ndate_2: "), day(30), F.lit("\n")).alias("value"))
    back = manifests.two_dates(manifests.read_texts(spark, _written(texts, "dates")))
    return back.select(F.regexp_extract("file", "([0-9]+)/dates.txt$", 1).cast("long").alias("id"), F.col("dates")[0].alias("t1"), F.col("dates")[1].alias("t2"))


def _npy(spark, sf):
    """Each scene as an NPY file: height, width, two channels; pixels that a scene lacks are NaN."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((SIDE, SIDE, 2), np.nan, np.float32)
        a[pdf["y"], pdf["x"], 0], a[pdf["y"], pdf["x"], 1] = pdf["b04"], pdf["b08"]
        out = io.BytesIO()
        np.save(out, a)
        return pd.DataFrame({"path": [str(pdf["scene_id"].iloc[0])], "content": [out.getvalue()]})

    return views.px(spark, sf).groupBy("scene_id").applyInPandas(pack, "path string, content binary")


@query("A10", f"WITH {PX} SELECT scene_id, y, x, round(b04::FLOAT::DOUBLE, 4) AS b04, round(b08::FLOAT::DOUBLE, 4) AS b08 FROM px")
def a10(spark, sf):
    rows = arrays.pixels(_npy(spark, sf)).filter("finite")
    c = F.col("channels")
    return rows.select(F.col("path").cast("long").alias("scene_id"), "y", "x", F.round(c[0].cast("double"), 4).alias("b04"), F.round(c[1].cast("double"), 4).alias("b08"))


@query("D31", f"WITH {PX} SELECT 50 AS height, 50 AS width, 2 AS n_channels, 'float32' AS dtype, count(*) AS files, count(*) FILTER (n = 2500) AS finite FROM (SELECT count(*) AS n FROM px GROUP BY scene_id)")
def d31(spark, sf):
    return arrays.inventory(_npy(spark, sf))


_SIDES = f"""WITH {PX}, {PX2}, ch AS (SELECT scene_id AS pair_id, unnest([{{'c': 'B04', 'a': a.b04, 'b': b.b04}}, {{'c': 'B08', 'a': a.b08, 'b': b.b08}}]) AS t FROM px a JOIN px2 b USING (scene_id, y, x)),
 r AS (SELECT pair_id, t.c AS channel, t.a::DOUBLE AS a, t.b::DOUBLE AS b, (t.b - t.a) / (abs(t.a) + abs(t.b) + 1e-8) AS nd FROM ch)"""


def _sides(spark, sf):
    """Both dates of all scenes as (pair_id, channel, y, x, a, b)."""
    a, b = views.px(spark, sf), views.px2(spark, sf)
    both = a.select(F.col("scene_id").alias("pair_id"), "y", "x", "b04", "b08").join(b.select(F.col("scene_id").alias("pair_id"), "y", "x", F.col("b04").alias("c04"), F.col("b08").alias("c08")), ["pair_id", "y", "x"])
    return both.select("pair_id", "y", "x", F.expr("stack(2, 'B04', b04, c04, 'B08', b08, c08) AS (channel, a, b)"))


@query("D33", f"""{_SIDES}, per AS (SELECT pair_id, channel, corr(a, b) AS r, avg(abs(b - a)) AS mae FROM r GROUP BY ALL),
 c AS (SELECT pair_id, round(quantile_cont(r, 0.5), 6) + 0 AS pearson_median, round(min(r), 6) + 0 AS pearson_low, round(max(r), 6) + 0 AS pearson_high, round(quantile_cont(mae, 0.5), 6) AS mae_median FROM per GROUP BY pair_id),
 w AS (SELECT pair_id, round(avg(abs(b - a)) / (avg((abs(a) + abs(b)) / 2) + 1e-8), 6) AS relative_mae, round(min(nd), 6) + 0 AS nd_low, round(max(nd), 6) + 0 AS nd_high, round(avg(nd), 6) + 0 AS nd_mean, round(avg((abs(nd) >= 0.5)::INT), 6) AS over_half, round(avg((abs(nd) >= 0.8)::INT), 6) AS over_08,
  round(quantile_cont(nd, 0.5), 6) + 0 AS nd_median, round(quantile_cont(nd, 0.9), 6) + 0 AS nd_p90, round(quantile_cont(nd, 0.95), 6) + 0 AS nd_p95, round(quantile_cont(nd, 0.99), 6) + 0 AS nd_p99 FROM r GROUP BY pair_id),
 d AS (SELECT scene_id AS pair_id, array_to_string(list_sort(list(DISTINCT scl))[:32], ',') AS classes FROM px GROUP BY scene_id) SELECT * FROM c JOIN w USING (pair_id) JOIN d USING (pair_id)""")
def d33(spark, sf):
    classes = raster.distinct_values(views.px(spark, sf).withColumnRenamed("scene_id", "pair_id"), "pair_id", "scl")
    return raster.pair_similarity(_sides(spark, sf)).join(classes.select("pair_id", F.array_join("values", ",").alias("classes")), "pair_id")


@query("D33_channels", f"""{_SIDES}, s AS (SELECT pair_id, channel, 'a' AS side, a AS v FROM r UNION ALL SELECT pair_id, channel, 'b', b FROM r) SELECT pair_id, channel, side, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean,
 round(avg(isfinite(v)::INT), 6) AS finite_share, round(avg((v = 0)::INT), 6) AS zero_share, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM s GROUP BY ALL""")
def d33_channels(spark, sf):
    return raster.channel_values(_sides(spark, sf))


@query("A19", "SELECT label % 3 AS layer_no, count(*) AS n FROM embeddings GROUP BY 1")
def a19(spark, sf):
    rows = views.read(spark, sf, "embeddings").select(
        F.concat(F.lit("layer"), (F.col("label") % 3).cast("string")).alias("layer"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(0.0), F.lit(1.0)).alias("coordinates")).alias("geometry"),
        F.struct(F.col("vec_id")).alias("properties"),
    )
    path = new_path(spark, "layers")
    sinks.write_layers(rows, path)
    return spark.read.text(path).groupBy(F.regexp_extract("layer", "[0-9]+", 0).cast("int").alias("layer_no")).agg(F.count("*").alias("n"))


_BOX = (10.0, -20.0, 16.0, 40.0)
_BOX_SIDES = "SELECT z AS zone, n AS north, CASE side WHEN 0 THEN {0} WHEN 1 THEN {2} ELSE {0} + ({2} - {0}) * f END AS lng, CASE side WHEN 2 THEN {1} WHEN 3 THEN {3} ELSE {1} + ({3} - {1}) * f END AS lat FROM (SELECT unnest(range(1, 61))::INT AS z), (SELECT unnest([true, false]) AS n), (SELECT unnest(range(0, 23)) / 22 AS f), (SELECT unnest(range(0, 4)) AS side)".format(*(f"{v}::DOUBLE" for v in _BOX))
_SHIFT = "CASE WHEN north THEN 0 ELSE 1e7 END"


def _corner(y: str, x: str, a: str, b: str) -> str:
    return utm_sql(f"SELECT scene_id, ymin >= 0 AS north, {y} AS lat, {x} AS lng, (floor((xmin + 180) / 6) + 1)::INT AS zone FROM scenes", "scene_id, north, zone", a, b)


@query("B6", f"""WITH {SCENES}, lo AS ({_corner("ymin", "xmin", "l", "b")}), hi AS ({_corner("ymax", "xmax", "r", "t")}),
 q AS (SELECT zone, north, min(e) AS w, max(e) AS x, min(n + {_SHIFT}) AS s, max(n + {_SHIFT}) AS y FROM ({utm_sql(f"SELECT * FROM ({_BOX_SIDES}) WHERE abs(lng - (zone * 6 - 183)) < 80", "zone, north", "e", "n")}) GROUP BY zone, north)
 SELECT scene_id, lo.zone FROM lo JOIN hi USING (scene_id) JOIN q ON q.zone = lo.zone AND q.north = lo.north WHERE l <= x AND r >= w AND b + CASE WHEN lo.north THEN 0 ELSE 1e7 END <= y AND t + CASE WHEN lo.north THEN 0 ELSE 1e7 END >= s""")
def b6(spark, sf):
    """Scenes with bounds in their own UTM zone, and a box in degrees."""
    zone, north = (F.floor((F.col("xmin") + 180) / 6) + 1).cast("int"), F.col("ymin") >= 0
    s = views.scenes(spark, sf).withColumn("zone", zone).withColumn("north", north)
    low, high = (geo.utm(F.col(y), F.col(x), F.col("zone"), F.col("north")) for y, x in (("ymin", "xmin"), ("ymax", "xmax")))
    s = s.select("scene_id", "zone", "north", low.alias("lo"), high.alias("hi"))
    s = s.select("scene_id", "zone", "north", F.col("lo.easting").alias("left"), F.col("lo.northing").alias("bottom"), F.col("hi.easting").alias("right"), F.col("hi.northing").alias("top"))
    return catalog.in_crs_box(s, _BOX).select("scene_id", "zone")


@query("F5", f"""WITH {PX}, v AS (SELECT scene_id, y, x, CASE WHEN scl NOT IN (0,1,3,8,9,10,11) AND b04 > 0 THEN b04 END AS v FROM px),
 o AS (SELECT unnest(range(-1, 2)) AS d),
 w AS (SELECT a.scene_id, a.y, a.x, any_value(a.v) AS v, sum(b.v) / count(b.v) AS m, sum(b.v * b.v) / count(b.v) AS q FROM v a, o oy, o ox LEFT JOIN v b ON b.scene_id = a.scene_id AND b.y = least(greatest(a.y + oy.d, 0), 49) AND b.x = least(greatest(a.x + ox.d, 0), 49) GROUP BY a.scene_id, a.y, a.x),
 s AS (SELECT scene_id, y, x, v, m, greatest(q - m * m, 0) AS var FROM w), n AS (SELECT scene_id, quantile_cont(var, 0.5) AS noise FROM s WHERE v IS NOT NULL GROUP BY scene_id)
 SELECT s.scene_id, y, x, round(CASE WHEN v IS NULL THEN 0 ELSE m + greatest(var - noise, 0) / (greatest(var - noise, 0) + noise + 1e-8) * (v - m) END, 5) AS filtered FROM s JOIN n ON n.scene_id = s.scene_id""")
def f5(spark, sf):
    rows = views.px(spark, sf).select("scene_id", "y", "x", F.when(pixels.scl_valid(F.col("scl")), F.col("b04")).alias("value"))
    return focal.lee_filter(rows, SIDE, SIDE, 3).withColumn("filtered", F.round("filtered", 5))


def _ring_sql(box: tuple[float, float, float, float]) -> str:
    """The points of rings r0 (id, pos, x, y), cut by one side of a box after the other, as r4."""
    steps = []
    for k, (axis, limit, op) in enumerate((("x", box[0], ">="), ("x", box[2], "<="), ("y", box[1], ">="), ("y", box[3], "<="))):
        t = f"({limit!r} - a{axis}) / ({axis} - a{axis})"
        cut = ", ".join(f"{limit!r} AS x" if c == axis == "x" else f"{limit!r} AS y" if c == axis else f"a{c} + {t} * ({c} - a{c}) AS {c}" for c in "xy")
        steps.append(f"""w{k} AS (SELECT id, pos, x, y, coalesce(lag(x) OVER o, last_value(x) OVER a) AS ax, coalesce(lag(y) OVER o, last_value(y) OVER a) AS ay FROM r{k} WINDOW o AS (PARTITION BY id ORDER BY pos), a AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 r{k + 1} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, s) - 1 AS pos, x, y FROM (SELECT id, pos, 0 AS s, {cut} FROM w{k} WHERE ({axis} {op} {limit!r}) <> (a{axis} {op} {limit!r}) UNION ALL SELECT id, pos, 1, x, y FROM w{k} WHERE {axis} {op} {limit!r}))""")
    return ",\n ".join(steps)


_CUT_BOX = (20.0, 20.0, 70.0, 70.0)
_LINE_SIDES = [(f"({p})", f"({q})") for p, q in (("x0 - x1", f"x0 - {_CUT_BOX[0]!r}"), ("x1 - x0", f"{_CUT_BOX[2]!r} - x0"), ("y0 - y1", f"y0 - {_CUT_BOX[1]!r}"), ("y1 - y0", f"{_CUT_BOX[3]!r} - y0"))]


@query("F8", f"""WITH pt AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (event_id % 97)::DOUBLE AS x, (value % 89)::DOUBLE AS y FROM events),
 seg AS (SELECT id, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WHERE id % 2 <> 0 WINDOW w AS (PARTITION BY id ORDER BY pos)),
 cut AS (SELECT *, greatest(0.0::DOUBLE, {", ".join(f"CASE WHEN {p} < 0 THEN {q} / {p} END" for p, q in _LINE_SIDES)}) AS t0, least(1.0::DOUBLE, {", ".join(f"CASE WHEN {p} > 0 THEN {q} / {p} END" for p, q in _LINE_SIDES)}) AS t1 FROM seg WHERE x1 IS NOT NULL AND NOT ({" OR ".join(f"({p} = 0 AND {q} < 0)" for p, q in _LINE_SIDES)})),
 kept AS (SELECT id, pos, {", ".join(f"CASE t{e} WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 ELSE {c}0 + t{e} * ({c}1 - {c}0) END AS {n}{c}" for e, n in enumerate("uv") for c in "xy")} FROM cut WHERE t0 <= t1),
 flag AS (SELECT k.*, coalesce(NOT (p.vx = k.ux AND p.vy = k.uy), true) AS new FROM kept k LEFT JOIN kept p ON p.id = k.id AND p.pos = k.pos - 1),
 line_pt AS (SELECT id, sum(new::INT) OVER (PARTITION BY id ORDER BY pos) - 1 AS part, pos, ux, uy, vx, vy, new FROM flag),
 both_pt AS (SELECT id, part, pos, 0 AS s, ux AS x, uy AS y FROM line_pt WHERE new UNION ALL SELECT id, part, pos, 1, vx, vy FROM line_pt WHERE new OR ux <> vx OR uy <> vy),
 e0 AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, first_value(x) OVER (PARTITION BY id ORDER BY pos) AS fx, first_value(y) OVER (PARTITION BY id ORDER BY pos) AS fy FROM pt WHERE id % 2 = 0),
 c0 AS (SELECT * FROM e0 WHERE NOT (n > 1 AND pos = n - 1 AND x = fx AND y = fy)), r0 AS (SELECT id, pos, x, y FROM c0 WHERE id IN (SELECT id FROM c0 GROUP BY id HAVING count(*) > 2)),
 {_ring_sql(_CUT_BOX)}, big AS (SELECT id, count(*) AS n FROM r4 GROUP BY id HAVING count(*) > 2)
 SELECT id, part::INT AS part, row_number() OVER (PARTITION BY id ORDER BY pos, s) - 1 AS pos, x, y FROM both_pt
 UNION ALL SELECT id, 0, pos, x, y FROM r4 JOIN big USING (id) UNION ALL SELECT id, 0, n, x, y FROM r4 JOIN big USING (id) WHERE pos = 0""")
def f8(spark, sf):
    """Lines and rings through users' events, cut to a box."""
    points = views.read(spark, sf, "events").select(
        F.col("user_id").alias("id"), (F.col("user_id") % 2 == 0).alias("closed"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).cast("double").alias("x"), (F.col("value") % 89).cast("double").alias("y")
    )
    return clipping.clip_elements(points, _CUT_BOX)


def _wave(at: str, n: str) -> tuple[str, str]:
    return f"cos(2 * pi() * ({at}) / {n})", f"sin(2 * pi() * ({at}) / {n})"


def _hann(at: str, n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * {at} / ({n} - 1)) END"


_CX, _SX = _wave("(u * x) % w", "w")
_CY, _SY = _wave("(v * y) % h", "h")
#: Phase correlation by sums over cosines and sines, first along one axis, then along the other.
_F9 = f"""WITH {PX}, {PX2}, px_pair AS (SELECT scene_id AS pair_id, y, x, unnest([{{'c': 'B04', 'a': a.b04, 'b': b.b04}}, {{'c': 'B08', 'a': a.b08, 'b': b.b08}}]) AS t FROM px a JOIN px2 b USING (scene_id, y, x)),
 raw AS (SELECT pair_id, t.c AS channel, y, x, t.a::DOUBLE AS a, t.b::DOUBLE AS b FROM px_pair), dim AS (SELECT pair_id, channel, max(y) + 1 AS h, max(x) + 1 AS w FROM raw GROUP BY ALL),
 cell AS (SELECT pair_id, channel, h, w, y, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM dim)),
 full_grid AS (SELECT c.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM cell c LEFT JOIN raw USING (pair_id, channel, y, x)),
 st AS (SELECT pair_id, channel, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM full_grid GROUP BY ALL),
 z AS (SELECT pair_id, channel, h, w, y, x, greatest(-5, least(5, (a - ma) / (sa + 1e-12))) * ({_hann('y', 'h')}) * ({_hann('x', 'w')}) AS a, greatest(-5, least(5, (b - mb) / (sb + 1e-12))) * ({_hann('y', 'h')}) * ({_hann('x', 'w')}) AS b
  FROM full_grid JOIN st USING (pair_id, channel) WHERE least(sa, sb) >= 1e-8),
 fx AS (SELECT pair_id, channel, h, w, y, u, sum(a * {_CX}) AS ar, -sum(a * {_SX}) AS ai, sum(b * {_CX}) AS br, -sum(b * {_SX}) AS bi FROM (SELECT *, unnest(range(w)) AS u FROM z) GROUP BY ALL),
 fy AS (SELECT pair_id, channel, h, w, v, u, sum(ar * {_CY} + ai * {_SY}) AS ar, sum(ai * {_CY} - ar * {_SY}) AS ai, sum(br * {_CY} + bi * {_SY}) AS br, sum(bi * {_CY} - br * {_SY}) AS bi FROM (SELECT *, unnest(range(h)) AS v FROM fx) GROUP BY ALL),
 cross_power AS (SELECT pair_id, channel, h, w, v, u, ar * br + ai * bi AS r, ai * br - ar * bi AS i FROM fy), ph AS (SELECT * REPLACE (r / greatest(sqrt(r * r + i * i), 1e-12) AS r, i / greatest(sqrt(r * r + i * i), 1e-12) AS i) FROM cross_power),
 gy AS (SELECT pair_id, channel, h, w, y, u, sum((r * {_CY} - i * {_SY}) / h) AS r, sum((i * {_CY} + r * {_SY}) / h) AS i FROM (SELECT *, unnest(range(h)) AS y FROM ph) GROUP BY ALL),
 corr AS (SELECT pair_id, channel, h, w, y, x, sum((r * {_CX} - i * {_SX}) / w) AS c FROM (SELECT *, unnest(range(w)) AS x FROM gy) GROUP BY ALL),
 top AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY pair_id, channel ORDER BY round(c, 9) DESC, y, x) = 1), mass AS (SELECT pair_id, channel, avg(abs(c)) AS m FROM corr GROUP BY ALL),
 near AS (SELECT t.*, m, max(n.c) FILTER (n.x = t.x AND n.y = (t.y + h - 1) % h) AS up, max(n.c) FILTER (n.x = t.x AND n.y = (t.y + 1) % h) AS down, max(n.c) FILTER (n.y = t.y AND n.x = (t.x + w - 1) % w) AS lft, max(n.c) FILTER (n.y = t.y AND n.x = (t.x + 1) % w) AS rgt
  FROM top t JOIN mass USING (pair_id, channel) JOIN (SELECT pair_id, channel, y, x, c FROM corr) n USING (pair_id, channel) GROUP BY ALL),
 fine AS (SELECT *, y + CASE WHEN abs(up - 2 * c + down) < 1e-12 THEN 0 ELSE 0.5 * (up - down) / (up - 2 * c + down) END AS fy, x + CASE WHEN abs(lft - 2 * c + rgt) < 1e-12 THEN 0 ELSE 0.5 * (lft - rgt) / (lft - 2 * c + rgt) END AS fx FROM near),
 sh AS (SELECT pair_id, channel, CASE WHEN fy > h / 2 THEN fy - h ELSE fy END AS dy, CASE WHEN fx > w / 2 THEN fx - w ELSE fx END AS dx, c / (m + 1e-12) AS response FROM fine UNION ALL SELECT pair_id, channel, NULL, NULL, 0 FROM st WHERE least(sa, sb) < 1e-8),
 rep AS (SELECT pair_id, quantile_cont(dy, 0.5) AS my, quantile_cont(dx, 0.5) AS mx, min(dy) AS ly, max(dy) AS hy, min(dx) AS lx, max(dx) AS hx, quantile_cont(response, 0.5) AS resp FROM sh GROUP BY pair_id)
 SELECT pair_id, round(my, 5) + 0 AS shift_y, round(mx, 5) + 0 AS shift_x, round(ly, 5) + 0 AS least_y, round(hy, 5) + 0 AS most_y, round(lx, 5) + 0 AS least_x, round(hx, 5) + 0 AS most_x, round(resp, 5) + 0 AS response, round(sqrt(my * my + mx * mx), 5) AS shift, sqrt(my * my + mx * mx) > 1 AS over_1, sqrt(my * my + mx * mx) > 2 AS over_2 FROM rep"""


@query("F9", _F9)
def f9(spark, sf):
    long = _sides(spark, sf).withColumnsRenamed({"a": "before", "b": "after"})
    report = focal.shift_report(focal.pair_shifts(long))
    return report.select("pair_id", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("shift_y", "shift_x", "least_y", "most_y", "least_x", "most_x", "response", "shift")), "over_1", "over_2")


@query("G10", "SELECT 'index' AS held, vec_id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'catalog', vec_id, label + 1 FROM embeddings WHERE vec_id % 2 = 0")
def g10(spark, sf):
    """Index and catalogue together: a baseline, a later version of both, a third that is never published, the baseline again."""
    store = Store(spark, new_path(spark, "versions"))
    rows = views.read(spark, sf, "embeddings").select("vec_id", "label")
    small = rows.filter("vec_id % 2 = 0")
    baseline = store.commit({"index": small, "catalog": small.withColumn("label", F.col("label") + 1)})
    store.commit({"index": rows, "catalog": rows})
    store.prepare({"index": rows.limit(0)})
    store.restore(baseline)
    index, held = (store.read(t).select(F.lit(t).alias("held"), "vec_id", "label") for t in ("index", "catalog"))
    return index.union(held)


@query("J6", f"WITH {PX} SELECT scene_id, count(*) FILTER (truth NOT IN (0, 1)) AS bad_mask, count(*) FILTER (p IS NULL) AS missing, count(*) <> 2500 AS bad_shape FROM px GROUP BY scene_id")
def j6(spark, sf):
    return views.px(spark, sf).groupBy("scene_id").agg(F.count_if(~F.col("truth").isin(0, 1)).alias("bad_mask"), F.count_if(F.col("p").isNull()).alias("missing"), (F.count("*") != SIDE * SIDE).alias("bad_shape"))


def _ingested(spark, sf):
    """Landed tiles streamed into an index twice, each time by a new stream: the second adds nothing."""
    folder = new_path(spark, "ingest")
    rows = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id"), "label", F.concat_ws(" ", F.lit("tile"), "vec_id", F.lit("label"), "label").alias("words"))
    rows.write.parquet(f"{folder}/landed")
    for run in (0, 1):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/landed")
        jobs.ingest(stream, f"{folder}/store", f"{folder}/state{run}", embedding.hashed_encoder(), "words").awaitTermination()
    return f"{folder}/store"


@query("K1", "SELECT vec_id AS tile_id, label, 32 AS dimension FROM embeddings")
def k1(spark, sf):
    """What is indexed, with what the catalogue says of it."""
    path = _ingested(spark, sf)
    index, catalog_rows = (jobs.read_ingested(spark, path, t) for t in ("index", "catalog"))
    return index.select("tile_id", F.size("vector").alias("dimension")).join(catalog_rows.select("tile_id", "label"), "tile_id")


@query("K1_report", "SELECT * FROM (SELECT 0 AS number, 'success' AS status, 0::BIGINT AS count_before, n AS count_after, n AS added, 0::BIGINT AS already_indexed FROM (SELECT count(DISTINCT vec_id) AS n FROM embeddings) UNION ALL SELECT 1, 'already_indexed', n, n, 0, n FROM (SELECT count(DISTINCT vec_id) AS n FROM embeddings))")
def k1_report(spark, sf):
    return jobs.ingest_report(spark, _ingested(spark, sf)).select("number", "status", "count_before", "count_after", "added", "already_indexed")


@query("K2_stream", f"WITH {LEDGER}, rv AS (SELECT ledger_id AS candidate_id, seq, CASE action WHEN 'PURCHASE' THEN 'confirmed' WHEN 'ERROR' THEN 'rejected' WHEN 'CLICK' THEN 'flagged' ELSE 'pending' END AS decision FROM ledger), f AS (SELECT candidate_id, arg_min(decision, seq) AS held, min(seq) AS first_seq FROM rv WHERE decision IN ('confirmed', 'rejected') GROUP BY candidate_id) SELECT rv.candidate_id, rv.seq, rv.decision, CASE WHEN f.first_seq IS NULL OR rv.seq <= f.first_seq THEN 'accepted' WHEN rv.decision = f.held THEN 'idempotent' ELSE 'refused' END AS outcome, CASE WHEN f.first_seq IS NULL OR rv.seq <= f.first_seq THEN rv.decision ELSE f.held END AS status FROM rv LEFT JOIN f USING (candidate_id)")
def k2_stream(spark, sf):
    from .ledger_queries import decisions

    return jobs.replay(spark, decisions(spark, sf), new_path(spark, "review"), jobs.review)


@query("K3_stream", f"{_CHAIN} SELECT ledger_id, seq, previous_hash, event_hash FROM chain")
def k3_stream(spark, sf):
    return jobs.replay(spark, views.ledger(spark, sf).drop("event_id"), new_path(spark, "audit"), jobs.audit)


@query("L1", """WITH w AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(coalesce(url, ''), '\\s+'), lambda x: x <> '')) AS word FROM pages),
 h AS (SELECT page_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 32 AS dim, CASE WHEN ('0x' || substr(md5(word), 9, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS v FROM w),
 s AS (SELECT page_id, dim, sum(v)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT page_id, sqrt(sum(v * v)) AS n FROM s GROUP BY page_id)
 SELECT page_id, d::INT AS dim, round((coalesce(v / CASE WHEN n > 0 THEN n ELSE 1 END, 0))::FLOAT::DOUBLE, 6) + 0 AS value, NULL::VARCHAR AS error FROM (SELECT page_id, unnest(range(0, 32)) AS d FROM pages) LEFT JOIN n USING (page_id) LEFT JOIN (SELECT page_id, dim AS d, v FROM s) USING (page_id, d)""")
def l1(spark, sf):
    pages = views.read(spark, sf, "pages").select("page_id", "url")
    made = embedding.encode_rows(pages, "page_id", "url", embedding.hashed_encoder())
    return made.select("page_id", "error", F.posexplode_outer("vector").alias("dim", "v")).select("page_id", "dim", (F.round(F.col("v").cast("double"), 6) + 0).alias("value"), "error")


_SCALE, _CUT = 20.0, 0.85
_PAIR_P = f"round(1 / (1 + exp(-(abs(b.b04 - a.b04) / {_SCALE!r} - 2))), 6)::FLOAT"
_ANALYSIS = f"""WITH RECURSIVE {PX}, {PX2}, sc AS (SELECT a.scene_id, a.y, a.x, a.{_VALID} AND b.{_VALID} AS valid, CASE WHEN a.{_VALID} AND b.{_VALID} THEN {_PAIR_P} ELSE 0 END AS p FROM px a JOIN px2 b ON a.scene_id = b.scene_id AND a.y = b.y AND a.x = b.x),
 {reach(f'SELECT scene_id, y, x FROM sc WHERE valid AND p >= {_CUT}::FLOAT', name='0')}, big AS (SELECT c.* FROM comp0 c JOIN (SELECT scene_id, root FROM comp0 GROUP BY ALL HAVING count(*) >= 3) k USING (scene_id, root)), {_close('big')},
 {reach('SELECT scene_id, y, x FROM closed JOIN sc USING (scene_id, y, x) WHERE valid')},
 cand AS (SELECT scene_id, component_id, count(*) AS area, min(x) AS xmin, min(y) AS ymin, max(x) + 1 AS xmax, max(y) + 1 AS ymax, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, round(avg(p::DOUBLE), 6) AS mean_p, min(least(y, x, 49 - y, 49 - x)) < 1 AS edge FROM comp JOIN sc USING (scene_id, y, x) GROUP BY ALL),
 j AS (SELECT *, CASE WHEN edge THEN 'image_edge' ELSE '' END AS reasons, NOT edge AS retained FROM cand)"""


def _analysis(spark, sf):
    """Two rasters a scene, the second mirrored: pairs, patches, scores, masks, candidates, files."""
    rows = [v.select((2 * F.col("scene_id") + k).alias("raster_id"), "y", "x", "b04", pixels.scl_valid(F.col("scl")).alias("valid"), "scene_id") for k, v in enumerate((views.px(spark, sf), views.px2(spark, sf)))]
    headers = [
        r.select("raster_id", "scene_id").distinct().select(
            "raster_id", F.col("scene_id").cast("string").alias("tile_id"), F.to_timestamp(F.lit(f"2024-0{k + 1}-15 10:00:00")).alias("acquired"), F.lit("sentinel-2").alias("sensor"), F.lit("EPSG:32631").alias("crs"),
            F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), _geo().alias("transform"), F.array(*map(F.lit, (500000.0, 4599500.0, 500500.0, 4600000.0))).alias("bounds"), F.lit(4).alias("band_count"), F.lit("float32").alias("dtypes"),
        )
        for k, r in enumerate(rows)
    ]
    pairs = catalog.temporal_pairs(headers[0].unionByName(headers[1])).filter("reasons = ''").withColumn("unit_m", F.lit(1.0))
    settings = analysis.Settings(threshold=_CUT, least_area=3, close=True, reject_edge=True, patch=32, bands=("b04",))
    score = F.round(F.col("mean_p") * F.log1p("area"), 6)
    return analysis.analyse(pairs, rows[0].unionByName(rows[1]).drop("scene_id"), analysis.logistic_scorer(_SCALE), new_path(spark, "analysis"), settings, score=score)


@query("L3", f"{_ANALYSIS} SELECT scene_id::VARCHAR || '__20240115_20240215' AS pair_id, component_id, area, mean_p, retained, reasons, {_RANK} AS rank, 10.0::DOUBLE * xmin + 500000 AS map_xmin, -10.0::DOUBLE * ymin + 4600000 AS map_ymax, 10.0::DOUBLE * (centroid_x + 0.5) + 500000 AS map_x, -10.0::DOUBLE * (centroid_y + 0.5) + 4600000 AS map_y, (area * 100)::DOUBLE AS area_m2 FROM j")
def l3(spark, sf):
    """Whole change analysis from two rasters: the candidates, read back from what the job has written."""
    return _analysis(spark, sf).candidates.select("pair_id", "component_id", "area", "mean_p", "retained", "reasons", "rank", "map_xmin", "map_ymax", "map_x", "map_y", "area_m2")


@query("A20", f"{_ANALYSIS}, n AS (SELECT d.scene_id, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND p >= 0.5) AS raw, round(coalesce(sum(p::DOUBLE), 0), 4) AS total FROM (SELECT DISTINCT scene_id FROM px) d LEFT JOIN sc ON sc.scene_id = d.scene_id GROUP BY d.scene_id), f AS (SELECT scene_id, sum(area)::BIGINT AS changed, count(*) AS components, count(*) FILTER (retained) AS retained FROM j GROUP BY scene_id) SELECT scene_id::VARCHAR || '__20240115_20240215' AS pair_id, raw, total, valid, coalesce(changed, 0) AS changed, coalesce(changed, 0) AS final, coalesce(components, 0) AS components, coalesce(f.retained, 0) AS retained, (coalesce(changed, 0) * 100)::DOUBLE AS area_m2, {_CUT}::DOUBLE AS threshold, 'closing' AS morphology, 'b04' AS bands FROM n LEFT JOIN f USING (scene_id)")
def a20(spark, sf):
    """Masks, probability and metadata as the job has written them, brought together by analysis."""
    made = _analysis(spark, sf)
    sums = made.pixels.groupBy("analysis_id").agg(F.sum("raw").alias("raw"), F.sum("final").alias("final"), F.round(F.sum(F.col("probability").cast("double")), 4).alias("total"))
    return made.metadata.join(sums, "analysis_id").select(
        "pair_id", "raw", "total", "statistics.valid", "statistics.changed", "final", "statistics.components", F.col("filtering.retained_components").alias("retained"),
        F.col("statistics.changed_area_m2").alias("area_m2"), "settings.threshold", "settings.morphology", "provenance.bands",
    )


@query("L7", f"WITH {SCENES}, f AS (SELECT * FROM scenes WHERE sensor = 'sentinel-2' AND acquired >= TIMESTAMP '1996-01-01' AND acquired <= TIMESTAMP '1998-12-31 23:59:59.999999' AND xmin <= 60 AND xmax >= 10 AND ymin <= 40 AND ymax >= -20 AND cloud < 60) SELECT count(*) AS found, count(*) FILTER (scene_no % 3 <> 0 OR scene_no % 2 = 0) AS added FROM f")
def l7(spark, sf):
    """Ingest of landed items: search, normalise, insert what is absent, report."""
    s = views.scenes(spark, sf)
    found = catalog.select_scenes(s, "s2", "1996-01-01", "1998-12-31", (10, -20, 60, 40), 60, strict_cloud=True)
    items = stac.normalise(stac.as_items(found)).select("scene_id", "acquired")
    old = s.filter("scene_no % 3 = 0 AND scene_no % 2 = 1").select("scene_id")
    added = catalog.insert_absent(old, items, "scene_id", "acquired")
    return items.agg(F.count("*").alias("found")).join(added.agg(F.count("*").alias("added")))


@query("A5", "SELECT c_name AS name, (c_custkey % 300 - 150)::DOUBLE AS west, (c_nationkey - 12)::DOUBLE AS south, (c_custkey % 300 - 148)::DOUBLE AS east, (c_nationkey - 11)::DOUBLE AS north FROM customer")
def a5(spark, sf):
    """Areas as landed GeoJSON lines: load, check, bounding box."""
    x, y = (F.col("c_custkey") % 300 - 150).cast("double"), (F.col("c_nationkey") - 12).cast("double")
    ring = F.array(*(F.array(x + a, y + b) for a, b in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_name").alias("name")).alias("properties"), geometry.alias("geometry")))
    path = _written(views.read(spark, sf, "customer").select(line.alias("value")), "areas", "text")
    return aoi.load(spark, path, multi_line=False).select("name", aoi.ring_box(F.col("rings")).alias("b")).select("name", "b.*")


@query("A11", "SELECT o_custkey::VARCHAR AS im_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS pair_idx, strftime(o_orderdate, '%Y%m%d') AS date, o_totalprice AS lat FROM orders")
def a11(spark, sf):
    """Pair metadata through CSV with a header."""
    empty = [F.lit(f"x{k}").alias(n) for k, n in enumerate(("time", "system_idx", "city", "city_ascii", "country"))]
    rows = views.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("im_idx"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("pair_idx"), F.lit("f.npy").alias("filename"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"), *empty, F.col("o_totalprice").alias("lat"), F.lit(0.0).alias("lng"),
    )
    path = new_path(spark, "pairs")
    rows.write.option("header", True).csv(path)
    return manifests.read_pairs(spark, path).select("im_idx", "pair_idx", "date", "lat")
