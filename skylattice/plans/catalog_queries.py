"""Queries of scene and tile catalogues (A, B1-B15, B32-B34, B37, B38, C1-C6, C15-C24, D28, D34, E5-E7, E12, E14, G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, pixels, times
from ..operators import catalog, reports
from ..operators.ranking import with_rank
from ..sources import sinks
from ..storage import Store, new_path
from . import views
from .registry import query
from .views import SCENES, TILES

S = f"WITH {SCENES} SELECT"
COLS = "scene_id, sensor, acquired, cloud"
LIST = ("scene_id", "sensor", "acquired", "cloud")


@query("A4", f"{S} {COLS} FROM scenes WHERE sensor = 'sentinel-2' AND acquired >= TIMESTAMP '1996-01-01' AND acquired <= TIMESTAMP '1997-06-30 23:59:59.999999' AND xmin <= 60 AND xmax >= 10 AND ymin <= 40 AND ymax >= -20 AND cloud < 30")
def a4(spark, sf):
    return catalog.select_scenes(views.scenes(spark, sf), "s2", "1996-01-01", "1997-06-30", (10, -20, 60, 40), 30, strict_cloud=True).select(*LIST)


@query("A3", f"{S} scene_id, sensor, CASE WHEN sensor = 'sentinel-1' THEN NULL ELSE cloud END AS cloud, CASE WHEN sensor = 'sentinel-1' THEN 'ascending' END AS orbit_direction FROM scenes")
def a3(spark, sf):
    from ..sources import stac

    return stac.normalise(stac.as_items(views.scenes(spark, sf))).select("scene_id", "sensor", "cloud", "orbit_direction")


@query("A6", "SELECT o_custkey AS aoi_id, min(o_orderkey % 100)::DOUBLE AS west, min(o_custkey % 50)::DOUBLE AS south, max(o_orderkey % 100)::DOUBLE AS east, max(o_custkey % 50)::DOUBLE AS north FROM orders GROUP BY o_custkey")
def a6(spark, sf):
    from ..sources import aoi

    point = F.array((F.col("o_orderkey") % 100).cast("double"), (F.col("o_custkey") % 50).cast("double"))
    rings = views.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("aoi_id")).agg(F.array(F.collect_list(point)).alias("coordinates"))
    return rings.select("aoi_id", aoi.ring_box(F.col("coordinates")).alias("b")).select("aoi_id", "b.*")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("A14", f"SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'absent' WHEN vec_id % 5 = 0 THEN 'model' WHEN label % 3 = 0 THEN 'version' WHEN vec_id % 4 = 0 THEN 'dimension' WHEN vec_id % 11 = 0 THEN 'fingerprint' WHEN NOT {_NORM} BETWEEN 1 - 1e-5 AND 1 + 1e-5 THEN 'norm' END AS reason FROM embeddings")
def a14(spark, sf):
    """What of a cache may be used, and why the rest may not."""
    from ..sources import cache

    rows = views.read(spark, sf, "embeddings").withColumn("tile_id", F.concat(F.lit("T"), F.col("vec_id").cast("string")))
    held = rows.filter("vec_id % 7 <> 0").select(
        "tile_id", F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("clip").alias("model"), F.when(F.col("label") % 3 == 0, "v0").otherwise("v1").alias("model_version"),
        F.size("embedding").alias("dimension"), F.when(F.col("vec_id") % 11 == 0, "stale").otherwise("f").alias("fingerprint"),
    )
    wanted = rows.select("tile_id", "vec_id", F.lit("v1").alias("model_version"), (F.size("embedding") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)).alias("dimension"), F.lit("f").alias("fingerprint"))
    return cache.usable(held, wanted, "clip").select("vec_id", "reason")


@query("A15", "SELECT vec_id, sha256('T' || vec_id) AS cache_key, 'm' || label % 2 AS model_version, len(embedding) AS dimension, true AS unit FROM embeddings WHERE sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0")
def a15(spark, sf):
    """Vectors through the cache on disk: written, a part of them written again, read back."""
    from ..sources import cache

    path = new_path(spark, "cache")
    rows = views.read(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("tile_id"), F.col("embedding").alias("vector"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_version"), F.lit("f").alias("fingerprint")
    )
    cache.write(rows, path, "model")
    cache.write(rows.filter("vec_id % 3 = 0"), path, "model")
    held = cache.read(spark, path).join(rows.select("tile_id", "vec_id"), "tile_id")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return held.select("vec_id", "cache_key", "model_version", "dimension", (F.abs(norm - 1) < 1e-5).alias("unit"))


@query("A17", f"{S} (row_number() OVER (ORDER BY cloud NULLS LAST, scene_id))::INT AS rank, scene_id, round(ymin, 5) AS lat, round(xmin, 5) AS lng, strftime(acquired, '%Y-%m-%d') AS day FROM scenes")
def a17(spark, sf):
    """All results through the CSV export."""
    path = new_path(spark, "results")
    sinks.write_csv(sinks.result_rows(views.scenes(spark, sf), [F.asc_nulls_last("cloud"), "scene_id"]), path)
    return sinks.read_csv(spark, path, "rank int, scene_id string, lat double, lng double, day string")


_AREAS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END AS name, c_acctbal % 200 AS lat, c_nationkey AS radius FROM customer"


@query("A22", f"WITH a AS ({_AREAS}), r AS (SELECT *, CASE WHEN trim(name) = '' THEN 'name' WHEN lat NOT BETWEEN -90 AND 90 THEN 'lat' WHEN radius <= 0 THEN 'radius' END AS reason FROM a) SELECT substr(sha256(trim(name) || '|2024-01-01T00:00:00Z'), 1, 16) AS area_id, trim(name) AS name, NULL AS reason FROM r WHERE reason IS NULL UNION ALL SELECT NULL, name, reason FROM r WHERE reason IS NOT NULL AND id % 2 = 1")
def a22(spark, sf):
    """A registry in two turns, the second with all rows again: what it holds, and what the first turn refused."""
    from ..sources import aoi

    blank = F.when(F.col("c_custkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    rows = views.read(spark, sf, "customer").select("c_custkey", blank.alias("name"), (F.col("c_acctbal") % 200).alias("lat"), F.lit(0.0).alias("lng"), F.col("c_nationkey").alias("radius_km"))
    store = Store(spark, new_path(spark, "areas"))
    refused = aoi.append(store, rows.filter("c_custkey % 2 = 1"), "2024-01-01T00:00:00Z")
    aoi.append(store, rows, "2024-01-01T00:00:00Z")
    held = store.read("areas").select("area_id", "name", F.lit(None).cast("string").alias("reason"))
    return held.unionByName(refused.select(F.lit(None).cast("string").alias("area_id"), "name", "reason"))


@query("B1", f"{S} scene_id, CASE scene_no % 4 WHEN 0 THEN 'sentinel-2' WHEN 1 THEN 'landsat' WHEN 2 THEN 'sentinel-1' END AS name FROM scenes")
def b1(spark, sf):
    alias = F.element_at(F.array(F.lit(" S2"), F.lit("Landsat"), F.lit("sentinel1"), F.lit("modis")), (F.col("scene_no") % 4 + 1).cast("int"))
    return views.scenes(spark, sf).select("scene_id", catalog.normalised_sensor(alias).alias("name"))


@query("B2", f"{S} {COLS} FROM scenes WHERE lower(coalesce(sensor, '')) = 'landsat'")
def b2(spark, sf):
    return catalog.by_sensor(views.scenes(spark, sf), "LANDSAT").select(*LIST)


@query("B3", f"{S} {COLS} FROM scenes WHERE acquired >= TIMESTAMP '1997-03-29' AND acquired <= TIMESTAMP '1997-04-29 23:59:59.999999'")
def b3(spark, sf):
    return catalog.select_scenes(views.scenes(spark, sf), start="1997-03-29", end="1997-04-29").select(*LIST)


@query("B4", f"{S} {COLS} FROM scenes WHERE xmin <= 20 AND xmax >= 0 AND ymin <= 10 AND ymax >= -10")
def b4(spark, sf):
    return catalog.select_scenes(views.scenes(spark, sf), box=(0, -10, 20, 10)).select(*LIST)


@query("B5", f"{S} scene_id, xmin <= xmax AND ymin <= ymax AS ordered, (xmax - xmin) * (ymax - ymin) > 0 AS has_area FROM scenes")
def b5(spark, sf):
    w, s, e, n = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    return views.scenes(spark, sf).select("scene_id", ((w <= e) & (s <= n)).alias("ordered"), ((e - w) * (n - s) > 0).alias("has_area"))


def utm_sql(rows: str, keep: str, easting: str = "easting", northing: str = "northing") -> str:
    """``keep`` and UTM metres, without the southern shift, of ``rows`` (lat, lng, zone)."""
    e, a = repr(2 * geo._N**0.5 / (1 + geo._N)), geo._ALPHA
    xi = "atan2(t, cos(lam))"
    eta = "asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam)))"
    x = f"eta + {' + '.join(f'{v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, v in enumerate(a, 1))}"
    y = f"xi + {' + '.join(f'{v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, v in enumerate(a, 1))}"
    return f"""SELECT {keep}, 500000 + 0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * ({x}) AS {easting}, 0.9996::DOUBLE * {geo._RADIUS!r}::DOUBLE * ({y}) AS {northing}
 FROM (SELECT *, {xi} AS xi, {eta} AS eta FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {e}::DOUBLE * atanh({e}::DOUBLE * sin(radians(lat)))) AS t, radians(lng - (zone * 6 - 183)) AS lam FROM ({rows})))"""


_CORNER = utm_sql("SELECT scene_id, ymin AS lat, xmin AS lng, floor((xmin + 180) / 6) + 1 AS zone FROM scenes", "scene_id, lat")


@query("B7", f"{S} scene_id, round(easting, 2) AS easting, round(northing + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 2) AS northing FROM ({_CORNER})")
def b7(spark, sf):
    zone = F.floor((F.col("xmin") + 180) / 6) + 1
    at = geo.utm(F.col("ymin"), F.col("xmin"), zone)
    return views.scenes(spark, sf).select("scene_id", at.alias("m")).select("scene_id", F.round("m.easting", 2).alias("easting"), F.round("m.northing", 2).alias("northing"))


def from_utm_sql(rows: str, keep: str) -> str:
    """``keep`` and degrees of ``rows`` (easting, northing, zone, north)."""
    xi0, eta0 = f"(northing - CASE WHEN north THEN 0 ELSE 1e7 END) / {0.9996 * geo._RADIUS!r}::DOUBLE", f"(easting - 500000) / {0.9996 * geo._RADIUS!r}::DOUBLE"
    x = f"eta0 - ({' + '.join(f'{v!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)' for j, v in enumerate(geo._BETA, 1))})"
    y = f"xi0 - ({' + '.join(f'{v!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)' for j, v in enumerate(geo._BETA, 1))})"
    lat = f"chi + {' + '.join(f'{v!r}::DOUBLE * sin({2 * j} * chi)' for j, v in enumerate(geo._DELTA, 1))}"
    return f"""SELECT {keep}, degrees({lat}) AS lat, zone * 6 - 183 + degrees(atan2(sinh(xx), cos(yy))) AS lng
 FROM (SELECT *, asin(sin(yy) / cosh(xx)) AS chi FROM (SELECT *, {x} AS xx, {y} AS yy FROM (SELECT *, {xi0} AS xi0, {eta0} AS eta0 FROM ({rows}))))"""


_METRES = "SELECT *, (scene_no % 60 + 1)::INT AS zone, scene_no % 2 = 0 AS north, 300000.0::DOUBLE + scene_no % 400 * 1000 AS left_m, 1000000.0::DOUBLE + scene_no % 7000 * 1000 AS bottom_m FROM scenes"


def _metres(spark, sf):
    """Scenes of 10.24 km in UTM metres of some zone."""
    n = F.col("scene_no")
    left, bottom = 300000.0 + n % 400 * 1000, 1000000.0 + n % 7000 * 1000
    return views.scenes(spark, sf).select("*", (n % 60 + 1).cast("int").alias("zone"), (n % 2 == 0).alias("north"), F.array(left, bottom, left + 10240, bottom + 10240).alias("bounds"))


_EDGE = "SELECT scene_id, zone, north, {p} FROM ({rows}), (SELECT unnest(range(0, 23)) / 22.0::DOUBLE AS f), (SELECT unnest([0, 1, 2, 3]) AS side)"
_EDGE_XY = "CASE side WHEN 2 THEN {w} WHEN 3 THEN {e} ELSE {w} + ({e} - {w}) * f END AS {x}, CASE side WHEN 0 THEN {s} WHEN 1 THEN {n} ELSE {s} + ({n} - {s}) * f END AS {y}"
_DEGREES = from_utm_sql(_EDGE.format(rows=_METRES, p=_EDGE_XY.format(w="left_m", e="(left_m + 10240)", s="bottom_m", n="(bottom_m + 10240)", x="easting", y="northing")), "scene_id")
_BACK = utm_sql(_EDGE.format(rows="SELECT *, (floor((xmin + 180) / 6) + 1)::INT AS zone, ymin >= 0 AS north FROM scenes", p=_EDGE_XY.format(w="xmin", e="xmax", s="ymin", n="ymax", x="lng", y="lat")), "scene_id, north")


@query("B7_bounds", f"{S} * FROM (SELECT scene_id, round(min(lng), 6) AS west, round(min(lat), 6) AS south, round(max(lng), 6) AS east, round(max(lat), 6) AS north FROM ({_DEGREES}) GROUP BY scene_id) JOIN (SELECT scene_id, round(min(easting), 2) AS utm_left, round(max(northing + CASE WHEN north THEN 0 ELSE 1e7 END), 2) AS utm_top FROM ({_BACK}) GROUP BY scene_id) USING (scene_id)")
def b7_bounds(spark, sf):
    """Boxes in metres to degrees and boxes in degrees to metres, by 21 points on each edge."""
    rows = _metres(spark, sf)
    zone, north = (F.floor((F.col("xmin") + 180) / 6) + 1).cast("int"), F.col("ymin") >= 0
    b, m = geo.degree_bounds(F.col("bounds"), F.col("zone"), F.col("north")), geo.utm_bounds(F.array("xmin", "ymin", "xmax", "ymax"), zone, north)
    rows = rows.select("scene_id", b.alias("b"), m.alias("m"))
    return rows.select("scene_id", *(F.round(F.col("b")[k], 6).alias(n) for k, n in enumerate(("west", "south", "east", "north"))), F.round(F.col("m")[0], 2).alias("utm_left"), F.round(F.col("m")[3], 2).alias("utm_top"))


_CIRCLE = "CASE WHEN cos(radians(ymin)) > 0.01 THEN cos(radians(ymin)) ELSE 0.01 END"


@query("B8", f"{S} scene_id, round(xmin - 25 / (111.320 * {_CIRCLE}), 6) AS west, round(ymin - 25 / 110.574, 6) AS south, round(xmin + 25 / (111.320 * {_CIRCLE}), 6) AS east, round(ymin + 25 / 110.574, 6) AS north FROM scenes")
def b8(spark, sf):
    box = geo.circle_box(F.col("ymin"), F.col("xmin"), F.lit(25.0))
    return views.scenes(spark, sf).select("scene_id", box.alias("b")).select("scene_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")))


@query("B9", f"{S} scene_id, unnest(range(0, 49))::INT AS i, round(xmin + 25 / (111.320 * {_CIRCLE}) * cos(unnest(range(0, 49)) * (2 * pi() / 48)), 6) AS lng, round(ymin + 25 / 110.574 * sin(unnest(range(0, 49)) * (2 * pi() / 48)), 6) AS lat FROM scenes")
def b9(spark, sf):
    ring = geo.circle_polygon(F.col("ymin"), F.col("xmin"), F.lit(25.0))
    return views.scenes(spark, sf).select("scene_id", F.posexplode(ring).alias("i", "p")).select("scene_id", "i", F.round(F.col("p")[0], 6).alias("lng"), F.round(F.col("p")[1], 6).alias("lat"))


@query("B10", f"{S} {COLS}, cloud IS NULL AS cloud_unknown FROM scenes WHERE cloud IS NULL OR cloud <= 20")
def b10(spark, sf):
    return catalog.cloud_filter(views.scenes(spark, sf), 20).select(*LIST, "cloud_unknown")


@query("B11", f"{S} scene_id, coalesce(cloud > 70, false) AS blocked FROM scenes")
def b11(spark, sf):
    return views.scenes(spark, sf).select("scene_id", F.coalesce(F.col("cloud") > 70, F.lit(False)).alias("blocked"))


@query("B13", f"{S} scene_id, 'downloaded' AS status FROM scenes WHERE downloaded UNION ALL SELECT scene_id, 'pending' FROM scenes WHERE NOT downloaded")
def b13(spark, sf):
    s = views.scenes(spark, sf)
    kinds = ((True, "downloaded"), (False, "pending"))
    done, left = (catalog.select_scenes(s, downloaded=k).select("scene_id", F.lit(n).alias("status")) for k, n in kinds)
    return done.union(left)


@query("B14", f"{S} {COLS}, region FROM scenes WHERE sensor = 'landsat' AND acquired >= TIMESTAMP '1996-01-01' AND acquired <= TIMESTAMP '1999-12-31 23:59:59.999999' AND lower(region) LIKE '1-ur%' AND xmin <= 100 AND xmax >= -100 AND ymin <= 50 AND ymax >= -50")
def b14(spark, sf):
    return catalog.select_scenes(views.scenes(spark, sf), "landsat", "1996-01-01", "1999-12-31", (-100, -50, 100, 50), region="1-UR").select(*LIST, "region")


_CENTRE = from_utm_sql(f"SELECT *, left_m + 5120 AS easting, bottom_m + 5120 AS northing FROM ({_METRES})", "*")


@query("B15", f"{S} 'T' || scene_no AS tile_id, round(lat, 7) AS lat, round(lng, 7) AS lng, scene_id AS region, strftime(acquired, '%Y-%m-%d') AS day, CASE sensor WHEN 'sentinel-2' THEN 's2|Sentinel-2|S2' WHEN 'landsat' THEN 'ls|Landsat|LS' ELSE 's1|Sentinel-1|S1' END AS sensor, cloud / 100 AS sim, cloud FROM ({_CENTRE})")
def b15(spark, sf):
    """Results as they are shown; the centre in degrees comes from bounds in metres."""
    tiles = _metres(spark, sf).select(F.concat(F.lit("T"), F.col("scene_no").cast("string")).alias("tile_id"), F.col("scene_id").alias("source_scene_id"), "sensor", "acquired", "bounds", "zone", "north", (F.col("cloud") / 100).alias("score"), "cloud")
    shown = catalog.public_result(tiles)
    return shown.withColumn("sensor", F.concat_ws("|", "sensor.id", "sensor.name", "sensor.tag")).withColumn("lat", F.round("lat", 7)).withColumn("lng", F.round("lng", 7))


@query("B32", f"{S} scene_id, CASE WHEN cloud >= 90 THEN 'high' WHEN cloud >= 75 THEN 'mid' ELSE 'low' END AS priority FROM scenes")
def b32(spark, sf):
    return views.scenes(spark, sf).select("scene_id", pixels.review_priority(F.col("cloud")).alias("priority"))


@query("B33", "SELECT page_id, regexp_replace(replace(regexp_replace(url, '[.][^./]*$', ''), '/', '__'), '[^A-Za-z0-9_.-]', '_', 'g') AS tile_id FROM pages")
def b33(spark, sf):
    from ..sources import manifests

    return views.read(spark, sf, "pages").select("page_id", manifests.stable_id(F.col("url")).alias("tile_id"))


@query("B34", "SELECT page_id, url || ':' || octet_length(encode(html))::VARCHAR || ':' || (page_id * 1000)::VARCHAR AS fingerprint FROM pages")
def b34(spark, sf):
    from ..sources import manifests

    return views.read(spark, sf, "pages").select("page_id", manifests.fingerprint(F.col("url"), F.octet_length("html"), F.col("page_id") * 1000).alias("fingerprint"))


_B37 = """WITH osm AS (SELECT l_orderkey, l_linenumber, l_partkey, ['highway','waterway','boundary','building','landuse','place'][(l_partkey % 6 + 1)::INT] AS k, CASE WHEN l_partkey % 6 = 0 AND l_suppkey % 2 = 0 THEN 'primary' WHEN l_partkey % 6 = 0 THEN 'residential' ELSE 'yes' END AS v, l_quantity > 25 AS closed FROM lineitem)"""


_LAYERS = "CASE k WHEN 'highway' THEN [CASE WHEN v = 'primary' THEN 'roads_major' ELSE 'roads_local' END] WHEN 'waterway' THEN CASE WHEN closed THEN ['water_line', 'water_area'] ELSE ['water_line'] END WHEN 'boundary' THEN ['boundaries'] WHEN 'building' THEN CASE WHEN closed THEN ['buildings'] ELSE [] END WHEN 'landuse' THEN CASE WHEN closed THEN ['context'] ELSE [] END ELSE ['places'] END"


def _layers(spark, sf):
    from ..operators import vector_layers

    kinds = F.array(*map(F.lit, ("highway", "waterway", "boundary", "building", "landuse", "place")))
    key = F.element_at(kinds, (F.col("l_partkey") % 6 + 1).cast("int"))
    value = F.when(key != "highway", "yes").when(F.col("l_suppkey") % 2 == 0, "primary").otherwise("residential")
    rows = views.read(spark, sf, "lineitem").select(F.create_map(key, value).alias("tags"), (F.col("l_quantity") > 25).alias("closed"))
    return vector_layers.classify(rows)


@query("B37", f"{_B37} SELECT layer, count(*) AS n FROM (SELECT unnest({_LAYERS}) AS layer FROM osm) GROUP BY layer")
def b37(spark, sf):
    return _layers(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


@query("D36", f"{_B37}, l AS (SELECT unnest({_LAYERS}) AS layer, closed FROM osm), n AS (SELECT layer, count(*) AS n, count(*) FILTER (closed) AS closed FROM l GROUP BY layer) SELECT *, (sum(n) OVER ())::BIGINT AS total FROM n")
def d36(spark, sf):
    from ..operators import vector_layers

    return vector_layers.counts(_layers(spark, sf))


@query("B38", f"{S} s.scene_id, k.key IS NOT NULL AS asked FROM scenes s LEFT JOIN (SELECT DISTINCT 'S' || vec_id AS key FROM embeddings) k ON s.scene_id = k.key WHERE k.key IS NOT NULL")
def b38(spark, sf):
    keys = views.read(spark, sf, "embeddings").select(F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("scene_id")).distinct()
    return views.scenes(spark, sf).join(keys, "scene_id", "left_semi").select("scene_id", F.lit(True).alias("asked"))


@query("C1", "SELECT s.o_orderkey AS raster_id, coalesce(c.c_name, 'scene_' || s.o_orderkey) AS source_scene, coalesce(c.c_acctbal, 1.0) AS valid_fraction FROM orders s LEFT JOIN customer c ON s.o_orderkey = c.c_custkey")
def c1(spark, sf):
    c = views.read(spark, sf, "customer").select(F.col("c_custkey").alias("raster_id"), "c_name", "c_acctbal")
    rows = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("raster_id")).join(c, "raster_id", "left")
    name = F.coalesce("c_name", F.concat(F.lit("scene_"), F.col("raster_id").cast("string")))
    return rows.select("raster_id", name.alias("source_scene"), F.coalesce("c_acctbal", F.lit(1.0)).alias("valid_fraction"))


_DAY = "d AS (SELECT sensor, acquired::DATE AS day, max(cloud) AS day_cloud FROM scenes WHERE acquired IS NOT NULL GROUP BY ALL HAVING count(DISTINCT cloud) = 1)"


@query("C5", f"WITH {SCENES}, {_DAY} SELECT s.scene_id, d.day_cloud FROM scenes s LEFT JOIN d ON s.sensor = d.sensor AND s.acquired::DATE = d.day")
def c5(spark, sf):
    s = views.scenes(spark, sf)
    days = catalog.day_cloud(s)
    return s.withColumn("day", F.to_date("acquired")).join(days, ["sensor", "day"], "left").select("scene_id", "day_cloud")


_RASTERS = """r AS (SELECT scene_no % 700 AS tile_id, scene_id AS raster_id, acquired, sensor, CASE WHEN scene_no % 23 <> 0 THEN 'EPSG:' || (32600 + scene_no % 2) END AS crs, 100 + (scene_no % 5 // 4) AS width, 100 AS height, [10.0, 0.0, (scene_no % 7 // 6)::DOUBLE, 0.0, -10.0, 0.0] AS transform,
 [xmin, ymin, xmax, ymax] AS bounds, 3 + (scene_no % 4 + 2) // 3 AS band_count, CASE WHEN scene_no % 9 = 0 THEN 'int16' ELSE 'float32' END AS dtypes FROM scenes WHERE acquired IS NOT NULL)"""
_CHECKS = """array_to_string(list_filter([CASE WHEN a.acquired = b.acquired THEN 'same_time' END, CASE WHEN a.sensor <> b.sensor THEN 'sensor' END, CASE WHEN a.crs IS NULL OR b.crs IS NULL THEN 'no_crs' END, CASE WHEN a.crs IS DISTINCT FROM b.crs THEN 'crs' END,
 CASE WHEN a.width <> b.width OR a.height <> b.height THEN 'size' END, CASE WHEN a.transform <> b.transform THEN 'transform' END, CASE WHEN a.bounds <> b.bounds THEN 'bounds' END, CASE WHEN a.band_count <> b.band_count THEN 'band_count' END, CASE WHEN a.dtypes <> b.dtypes THEN 'dtypes' END,
 CASE WHEN a.sensor = 'sentinel-2' AND least(a.band_count, b.band_count) < 4 THEN 'bands' END], lambda z: z IS NOT NULL), ',')"""
_NEAR = "a.tile_id = b.tile_id AND (a.acquired, a.raster_id) < (b.acquired, b.raster_id) AND epoch(b.acquired) - epoch(a.acquired) <= 86400 * 400"


@query("C6", f"WITH {SCENES}, {_RASTERS}, f AS (SELECT a.tile_id || '__' || strftime(a.acquired, '%Y%m%d') || '_' || strftime(b.acquired, '%Y%m%d') AS pair_id, a.raster_id AS raster_1, b.raster_id AS raster_2, {_CHECKS} AS reasons FROM r a JOIN r b ON {_NEAR} UNION ALL SELECT b.tile_id || '__' || strftime(b.acquired, '%Y%m%d') || '_' || strftime(a.acquired, '%Y%m%d'), b.raster_id, a.raster_id, {_CHECKS.replace("a.sensor =", "b.sensor =")} FROM r a JOIN r b ON {_NEAR} AND a.acquired < b.acquired) SELECT * FROM f")
def c6(spark, sf):
    """Pairs up to 400 days apart, in both orders, with all reasons why they do not fit."""
    n = F.col("scene_no")
    rasters = views.scenes(spark, sf).select(
        (n % 700).alias("tile_id"), F.col("scene_id").alias("raster_id"), "acquired", "sensor", F.when(n % 23 != 0, F.concat(F.lit("EPSG:"), (32600 + n % 2).cast("string"))).alias("crs"),
        (100 + F.expr("scene_no % 5 div 4")).alias("width"), F.lit(100).alias("height"), F.array(F.lit(10.0), F.lit(0.0), F.expr("scene_no % 7 div 6").cast("double"), F.lit(0.0), F.lit(-10.0), F.lit(0.0)).alias("transform"),
        F.array("xmin", "ymin", "xmax", "ymax").alias("bounds"), (3 + F.expr("(scene_no % 4 + 2) div 3")).alias("band_count"), F.when(n % 9 == 0, "int16").otherwise("float32").alias("dtypes"),
    )
    return catalog.temporal_pairs(rasters, within_days=400, reversed_too=True).select("pair_id", "raster_1", "raster_2", "reasons")


@query("C15", "SELECT o_orderkey AS missing FROM orders WHERE o_orderkey NOT IN (SELECT DISTINCT l_orderkey FROM lineitem)")
def c15(spark, sf):
    files = views.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return views.read(spark, sf, "orders").join(files, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("missing"))


@query("C16", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'unreferenced' WHEN a.k IS NULL THEN 'missing' ELSE 'both' END AS state FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey % 2 = 0) b ON a.k = b.k")
def c16(spark, sf):
    a = views.read(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("in_a", F.lit(True))
    b = views.read(spark, sf, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "unreferenced").when(F.col("in_a").isNull(), "missing").otherwise("both")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query("C19", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def c19(spark, sf):
    known = views.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return views.read(spark, sf, "orders").join(known, "o_custkey", "left_semi").select("o_orderkey")


@query("C21", f"{S} scene_id, n_nationkey AS region_id FROM scenes, nation QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY round(sqrt(power(n_nationkey * 5 - 60 - ymin, 2) + power((n_nationkey * 13 % 300 - 150 - xmin) * cos(radians(ymin)), 2)), 9), n_nationkey) = 1")
def c21(spark, sf):
    k = F.col("n_nationkey")
    regions = views.read(spark, sf, "nation").select(k.alias("region_id"), (k * 5 - 60).cast("double").alias("lat"), (k * 13 % 300 - 150).cast("double").alias("lng"))
    return catalog.nearest_region(views.scenes(spark, sf).select("scene_id", F.col("ymin").alias("y"), F.col("xmin").alias("x")), regions, "scene_id")


@query("C24", f"{S} scene_id, scene_no IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS local FROM scenes")
def c24(spark, sf):
    files = views.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_no")).distinct().withColumn("f", F.lit(True))
    return views.scenes(spark, sf).join(files, "scene_no", "left").select("scene_id", F.coalesce("f", F.lit(False)).alias("local"))


@query("D28", "SELECT 'tiles' AS name, count(*) AS n FROM embeddings UNION ALL SELECT 'scenes', count(*) FROM orders UNION ALL SELECT 'pending', count(*) FROM events WHERE event_type IN ('view', 'error') UNION ALL SELECT 'aois', count(*) FROM customer")
def d28(spark, sf):
    def n(name: str, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    r = lambda t: views.read(spark, sf, t)
    return n("tiles", r("embeddings")).union(n("scenes", r("orders"))).union(n("pending", r("events").filter("event_type IN ('view', 'error')"))).union(n("aois", r("customer")))


_OLDNEW = """old AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 2 = 0),
 acts AS (SELECT new.k, CASE WHEN old.k IS NULL THEN 'add' WHEN old.v <> new.v THEN 'update' ELSE 'same' END AS action FROM new LEFT JOIN old ON old.k = new.k)"""


def _old_new(spark, sf):
    o = views.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    old = o.filter("k % 3 <> 0")
    new = o.filter("k % 2 = 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return old, new


@query("G2", f"WITH {_OLDNEW} SELECT k, action FROM acts")
def g2(spark, sf):
    return catalog.merge_actions(*_old_new(spark, sf), "k", ["v"], "v")


@query("A16", f"WITH {_OLDNEW}, m AS (SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new) SELECT k, v, (SELECT count(*) FROM old) AS before FROM m")
def a16(spark, sf):
    """The catalogue sink: what readers see until the new version is published, and what they see then."""
    store = Store(spark, new_path(spark, "catalog"))
    old, new = _old_new(spark, sf)
    store.commit({"catalog": old}, {"catalog": ["k"]})
    version = store.prepare({"catalog": catalog.merge(store.read("catalog"), new, "k", "v")}, {"catalog": ["k"]})
    before = store.read("catalog").count()
    store.publish(version)
    return store.read("catalog").withColumn("before", F.lit(before)).orderBy("k")


@query("D34", f"WITH {_OLDNEW}, b AS (SELECT k FROM new UNION ALL SELECT k FROM new WHERE k % 40 = 0), u AS (SELECT k FROM old UNION SELECT k FROM new) SELECT (SELECT count(*) FROM b) AS discovered, (SELECT count(*) FROM acts WHERE action = 'add') AS added, (SELECT count(*) FROM acts WHERE action = 'update') AS updated, (SELECT count(*) FROM u) AS total, (SELECT count(*) FROM u WHERE k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 50 <> 0)) AS missing, (SELECT count(*) FROM new WHERE k % 40 = 0) AS duplicates")
def d34(spark, sf):
    """A build whose batch names some keys twice and whose files are partly gone."""
    old, new = _old_new(spark, sf)
    files = views.read(spark, sf, "lineitem").filter("l_orderkey % 50 <> 0").select(F.col("l_orderkey").alias("k"))
    return reports.build_report(old, new.union(new.filter("k % 40 = 0")), files, "k", ["v"], "v")


@query("G1", "SELECT l_orderkey AS k, min(l_partkey) AS first_part FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def g1(spark, sf):
    old = views.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    new = views.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("first_part"))
    return catalog.insert_absent(old, new, "k", "first_part")


@query("G3", "SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY p) = 1 AS kept FROM (SELECT l_orderkey AS k, l_extendedprice AS p FROM lineitem WHERE l_returnflag = 'N') QUALIFY count(*) OVER (PARTITION BY k) > 1")
def g3(spark, sf):
    rows = views.read(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("p"))
    return catalog.duplicate_keys(rows, "k", "p")


@query("G4", f"{S} scene_id, cloud, 'archive' AS record_type FROM scenes UNION ALL SELECT 'O' || event_id, NULL, 'observation' FROM events WHERE event_type = 'view'")
def g4(spark, sf):
    a = views.scenes(spark, sf).select("scene_id", "cloud", F.lit("archive").alias("record_type"))
    b = views.read(spark, sf, "events").filter("event_type = 'view'").select(F.concat(F.lit("O"), F.col("event_id").cast("string")).alias("scene_id"), F.lit("observation").alias("record_type"))
    return a.unionByName(b, allowMissingColumns=True)


@query("G7", "SELECT 'train_and_test' AS rule, c_custkey AS id FROM customer WHERE c_nationkey < 10 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'not_listed', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def g7(spark, sf):
    c = views.read(spark, sf, "customer")
    train = c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    test = views.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    all_used = views.read(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    both, unknown = train.intersect(test), all_used.distinct().exceptAll(c.select(F.col("c_custkey").alias("id")).distinct())
    return both.select(F.lit("train_and_test").alias("rule"), "id").union(unknown.select(F.lit("not_listed").alias("rule"), "id"))


@query("G8", "SELECT c_custkey AS id, ((row_number() OVER (ORDER BY sha256('7|' || c_custkey)) - 1) % 5)::INT AS fold FROM customer")
def g8(spark, sf):
    from ..operators import training

    return training.folds(views.read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", 5, 7)


@query("G9", "SELECT count(*) AS catalogued, (SELECT count(DISTINCT vec_id) FROM embeddings) AS indexed, count(*) FILTER (o_orderstatus = 'P') AS staged, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey IN (SELECT vec_id FROM embeddings)) AS staged_indexed, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT vec_id FROM embeddings)) AS waiting FROM orders")
def g9(spark, sf):
    o = views.read(spark, sf, "orders")
    index = views.read(spark, sf, "embeddings").select(F.col("vec_id").alias("o_orderkey"))
    return catalog.index_status(o, index, o.filter("o_orderstatus = 'P'"), "o_orderkey")


_MODES = {"similarity": "score DESC NULLS LAST", "newest": "acquired DESC NULLS LAST", "oldest": "acquired ASC NULLS LAST", "cloud": "cloud ASC NULLS LAST"}


@query("E5", f"WITH {SCENES}, s AS (SELECT *, CASE WHEN scene_no % 13 <> 0 THEN scene_no * 7919 % 1000 END AS score FROM scenes) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, row_number() OVER (ORDER BY {o}, scene_id) AS rank, scene_id FROM s" for m, o in _MODES.items()))
def e5(spark, sf):
    """All rows in each of the four orders."""
    rows = views.scenes(spark, sf).withColumn("score", F.when(F.col("scene_no") % 13 != 0, F.col("scene_no") * 7919 % 1000)).select("scene_id", "score", "acquired", "cloud")
    found = [with_rank(rows, [catalog.sort_order(m), "scene_id"]).select(F.lit(m).alias("mode"), F.col("rank").cast("long").alias("rank"), "scene_id") for m in _MODES]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("E6", "SELECT user_id, count(*) FILTER (event_type = 'click') = 1 AND count(*) FILTER (event_type = 'view') = 1 AS complete, CASE WHEN min(ts) FILTER (event_type = 'click') < min(ts) FILTER (event_type = 'view') THEN 'click_first' WHEN min(ts) FILTER (event_type = 'click') > min(ts) FILTER (event_type = 'view') THEN 'view_first' ELSE 'ambiguous' END AS chronology FROM events GROUP BY user_id")
def e6(spark, sf):
    kind = F.col("event_type")
    a, b = F.min(F.when(kind == "click", F.col("ts"))), F.min(F.when(kind == "view", F.col("ts")))
    complete = (F.count_if(kind == "click") == 1) & (F.count_if(kind == "view") == 1)
    order = F.when(a < b, "click_first").when(a > b, "view_first").otherwise("ambiguous")
    return views.read(spark, sf, "events").groupBy("user_id").agg(complete.alias("complete"), order.alias("chronology"))


@query("E12", f"{S} sensor, scene_id, (row_number() OVER (PARTITION BY sensor ORDER BY acquired, scene_id))::INT AS rank, round((epoch(acquired) - min(epoch(acquired)) OVER (PARTITION BY sensor)) / (max(epoch(acquired)) OVER (PARTITION BY sensor) - min(epoch(acquired)) OVER (PARTITION BY sensor)), 6) AS place FROM scenes WHERE acquired IS NOT NULL")
def e12(spark, sf):
    return catalog.timeline(views.scenes(spark, sf), "sensor")


@query("E14", f"{S} {COLS} FROM scenes WHERE acquired IS NOT NULL ORDER BY acquired DESC, scene_id LIMIT 25")
def e14(spark, sf):
    return views.scenes(spark, sf).filter("acquired IS NOT NULL").orderBy(F.desc("acquired"), "scene_id").limit(25).select(*LIST)


@query("D32", "SELECT o_custkey % 20 AS sensor_group, min(abs(d))::DOUBLE AS low, quantile_cont(abs(d)::DOUBLE, 0.5) AS median, max(abs(d))::DOUBLE AS high, count(*) FILTER (d > 0) AS first_earlier, count(*) FILTER (d < 0) AS second_earlier, count(*) FILTER (d = 0) AS same_day, count(*) FILTER (d = 0 AND same) AS same_acquisition FROM (SELECT a.o_custkey, date_diff('day', a.o_orderdate, b.o_orderdate) AS d, a.o_orderpriority = b.o_orderpriority AS same FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) GROUP BY 1")
def d32(spark, sf):
    """Pairs of a customer's orders, the smaller number as the first member."""
    a, b = (views.read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias(f"k_{k}"), F.col("o_orderdate").alias(f"at_{k}"), F.col("o_orderpriority").alias(f"acquisition_{k}")) for k in (1, 2))
    pairs = a.join(b, "o_custkey").filter("k_1 < k_2").withColumn("sensor_group", F.col("o_custkey") % 20)
    return catalog.gap_report(pairs, "sensor_group")


@query("H1", "SELECT event_id, ts::TIMESTAMP AS at FROM events")
def h1(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    return views.read(spark, sf, "events").select("event_id", times.parse_time(text).alias("at"))


@query("H2", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS at FROM events")
def h2(spark, sf):
    day, clock = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss").cast("int")
    return views.read(spark, sf, "events").select("event_id", times.compact_time(day, clock).alias("at"))


@query("H3", f"{S} scene_id, scene_id || '__' || strftime(acquired, '%Y%m%d') || '_' || strftime(acquired + INTERVAL 10 DAY, '%Y%m%d') AS pair_id FROM scenes WHERE acquired IS NOT NULL")
def h3(spark, sf):
    later = F.col("acquired") + F.expr("INTERVAL 10 DAY")
    name = F.format_string("%s__%s_%s", F.col("scene_id"), F.date_format("acquired", "yyyyMMdd"), F.date_format(later, "yyyyMMdd"))
    return views.scenes(spark, sf).filter("acquired IS NOT NULL").select("scene_id", name.alias("pair_id"))


@query("H4", f"{S} scene_id, sha256(scene_id) AS hash, regexp_matches(sha256(scene_id), '^[0-9a-f]{{64}}$') AS well_formed FROM scenes")
def h4(spark, sf):
    h = F.sha2("scene_id", 256)
    return views.scenes(spark, sf).select("scene_id", h.alias("hash"), h.rlike("^[0-9a-f]{64}$").alias("well_formed"))


@query("H6", "SELECT event_id, (props->>'$.k')::INT AS k, contains(props, '\"k\": 6') AS has_six FROM events")
def h6(spark, sf):
    return views.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.contains("props", F.lit('"k": 6')).alias("has_six"))


@query("H10", f"{S} scene_id, (xmax - xmin) * (ymax - ymin) AS area, (xmin + xmax) / 2 AS mid FROM scenes")
def h10(spark, sf):
    box = F.array("xmin", "ymin", "xmax", "ymax")
    return views.scenes(spark, sf).select("scene_id", box.alias("b")).select("scene_id", ((F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1])).alias("area"), ((F.element_at("b", 1) + F.element_at("b", 3)) / 2).alias("mid"))


@query("H12", f"WITH {TILES} SELECT tile_id, unnest(range(0, 5))::INT AS i, floor(unnest(range(0, 5)) * vec_id / 4)::BIGINT AS place FROM tiles")
def h12(spark, sf):
    spots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * F.col("vec_id") / 4))
    return views.tiles(spark, sf).select("tile_id", F.posexplode(spots).alias("i", "place"))
