"""Whole jobs: analysis of raster pairs, ingest, calibration, versions, caches, pairs and projections, by brute force and by failures."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice import storage
from skylattice.functions import geo
from skylattice.operators import analysis, calibration, catalog, embedding
from skylattice.sources import cache
from skylattice.storage import Store
from skylattice.streaming import jobs

# ------------------------------------------------------------------------------------- calibration


def brute_components(mask):
    label, out, n = np.zeros(mask.shape, int), [], 0
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        n += 1
        label[start], todo, held = n, [start], []
        while todo:
            y, x = todo.pop()
            held.append((y, x))
            for a, b in itertools.product((-1, 0, 1), repeat=2):
                q = (y + a, x + b)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                    label[q] = n
                    todo.append(q)
        out.append(held)
    return out


def brute_closing(mask):
    def near(m):
        wide = np.pad(m, 1)
        return np.stack([wide[1 + a : 1 + a + m.shape[0], 1 + b : 1 + b + m.shape[1]] for a, b in itertools.product((-1, 0, 1), repeat=2)])

    return near(near(mask).any(axis=0)).all(axis=0)


def brute_grid(scenes, thresholds, areas):
    out = {}
    for t, a, m in itertools.product(thresholds, areas, ("none", "closing")):
        tp = fp = fn = tn = 0
        for p, truth in scenes:
            kept = np.zeros(p.shape, bool)
            for part in brute_components(p >= np.float32(t)):
                if len(part) >= a:
                    kept[tuple(zip(*part, strict=True))] = True
            kept = brute_closing(kept) if m == "closing" else kept
            tp, fp, fn, tn = tp + (kept & truth).sum(), fp + (kept & ~truth).sum(), fn + (~kept & truth).sum(), tn + (~kept & ~truth).sum()
        out[t, a, m] = (tp, fp, fn, tn)
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_calibration_equals_brute_force(spark, block):
    draw = np.random.default_rng(4)
    scenes = []
    for _ in range(2):
        p = draw.random((20, 23)).astype(np.float32)
        p[5:9, 3:20] = 0.97
        p[0, :] = 0.85
        scenes.append((p, draw.random((20, 23)) < 0.3))
    rows = [(s, y, x, float(p[y, x]), int(truth[y, x])) for s, (p, truth) in enumerate(scenes) for y in range(20) for x in range(23)]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, p float, truth int").repartition(5)
    thresholds, areas = (0.5, 0.7, 0.85, 0.97, 0.999999), (0, 2, 9, 500)
    got = {(r["threshold"], r["area"], r["morphology"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in calibration.calibration_grid(px, thresholds, areas, 20, 23, block).collect()}
    assert got == brute_grid(scenes, thresholds, areas)


def test_calibration_of_nothing(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.1, 0), (1, 0, 1, None, 1)], "scene_id long, y int, x int, p float, truth int")
    rows = calibration.calibration_grid(px, height=1, width=2).collect()
    assert len(rows) == 160 and all((r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (0, 0, 1, 1, 0.0) for r in rows)


# ---------------------------------------------------------------------------------------- analysis


def header(raster, tile, day, size, **other):
    return {"raster_id": raster, "tile_id": tile, "acquired": f"2024-01-{day:02d}", "sensor": "sentinel-2", "crs": "EPSG:32631", "width": size[1], "height": size[0], "transform": [10.0, 0.0, 1000.0, 0.0, -10.0, 9000.0], "bounds": [0.0], "band_count": 4, "dtypes": "float32"} | other


def headers_of(spark, rows):
    schema = "raster_id long, tile_id string, acquired string, sensor string, crs string, width int, height int, transform array<double>, bounds array<double>, band_count int, dtypes string"
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema).withColumn("acquired", F.to_timestamp("acquired"))


def test_analysis_of_two_sizes(spark, tmp_path):
    sizes, draw, pixels = {"a": (9, 14), "b": (5, 5), "c": (3, 3)}, np.random.default_rng(1), []
    change = np.zeros((9, 14))
    change[2:5, 6:10], change[7:9, 0:2] = 900, 900
    for k, (_, (h, w)) in enumerate(sizes.items()):
        base = draw.random((h, w)) * 3
        for role in (0, 1):
            for y, x in itertools.product(range(h), range(w)):
                if k == 2 and role == 1:
                    continue  # a raster without pixels
                value = float(base[y, x] + (change[y, x] * role if k == 0 else 0))
                pixels.append((2 * k + role, y, x, float("nan") if (k, y, x) == (0, 3, 7) else value, 1.0, not (k == 1 and y == 0)))
    px = spark.createDataFrame(pixels, "raster_id long, y int, x int, b04 double, b03 double, valid boolean").repartition(4)
    rasters = headers_of(spark, [header(2 * k + role, t, 10 + role, s) for k, (t, s) in enumerate(sizes.items()) for role in (0, 1)])
    pairs = catalog.temporal_pairs(rasters).filter("reasons = ''").withColumn("unit_m", F.when(F.col("tile_id") != "b", 1.0))


    def scorer(before, after):
        assert before.shape == after.shape == (2, 4, 4) and np.isfinite(before).all()
        return analysis.logistic_scorer()(before, after)

    settings = analysis.Settings(threshold=0.9, least_area=3, patch=4, bands=("b04", "b03"))
    made = analysis.analyse(pairs, px, scorer, str(tmp_path / "out"), settings)

    found = {(r["pair_id"], r["rank"]): r for r in made.candidates.collect()}
    assert set(found) == {("a__20240110_20240111", 1), ("a__20240110_20240111", 2)}
    first = found["a__20240110_20240111", 1]
    assert {found[k]["area"] for k in found} == {11, 4}
    big = next(r for r in found.values() if r["area"] == 11)
    assert (big["map_xmin"], big["map_ymin"], big["map_xmax"], big["map_ymax"], big["area_m2"]) == (1060.0, 8950.0, 1100.0, 8980.0, 1100.0)
    assert first["crs"] == "EPSG:32631"
    sums = {r["analysis_id"]: (r["n"], r["valid"], r["final"]) for r in made.pixels.groupBy("analysis_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.sum("final").alias("final")).collect()}
    notes = {r["pair_id"][0]: r for r in made.metadata.collect()}
    assert {t: sums[notes[t]["analysis_id"]] for t in "abc"} == {"a": (126, 125, 15), "b": (25, 20, 0), "c": (9, 0, 0)}
    assert notes["a"]["statistics"]["changed"] == 15 and notes["a"]["statistics"]["changed_area_m2"] == 1500.0 and notes["a"]["filtering"]["retained_components"] == 2
    assert notes["b"]["pixel_area_m2"] is None and notes["a"]["bounds"] == [1000.0, 8910.0, 1140.0, 9000.0]
    assert made.pixels.filter("NOT valid AND (probability <> 0 OR raw <> 0 OR final <> 0)").isEmpty()


def test_analysis_refuses(spark, tmp_path):
    rasters = headers_of(spark, [header(0, "a", 1, (4, 4)), header(1, "a", 2, (4, 4))])
    pairs = catalog.temporal_pairs(rasters).withColumn("scene_id", F.lit(1).cast("long"))
    px = spark.createDataFrame([(r, y, x, 1.0, True) for r in (0, 1) for y in range(4) for x in range(4)], "raster_id long, y int, x int, b04 double, valid boolean")
    with pytest.raises(Exception, match="outside"):
        analysis.score_pairs(pairs, px, lambda a, b: a[0] + 1.5, 4, ("b04",)).collect()
    with pytest.raises(Exception, match="the scorer gave"):
        analysis.score_pairs(pairs, px, lambda a, b: a, 4, ("b04",)).collect()
    with pytest.raises(Exception, match="comes twice"):
        analysis.score_pairs(pairs, px.union(px), analysis.logistic_scorer(), 4, ("b04",)).collect()
    whole = analysis.score_pairs(pairs, px, analysis.logistic_scorer(), 3, ("b04",))
    assert analysis.mosaic(whole, pairs).count() == 16
    for wrong in (whole.filter("x <> 3"), whole.union(whole.filter("x = 3")), whole.filter("x < 3").union(whole.filter("x = 0"))):
        with pytest.raises(ValueError, match="overlap or leave"):
            analysis.mosaic(wrong, pairs)
    with pytest.raises(ValueError):
        analysis.Settings(threshold=1.5)


@pytest.mark.parametrize("batch", [5, 10000])
def test_small_groups_share_batches(spark, batch):
    """Many small patches and scenes in a batch, and groups over many batches, against one at a time."""
    from skylattice.operators import components, groups

    draw = np.random.default_rng(4)
    values = {k: draw.random((2, 5, 3)) * 90 for k in range(30)}
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1, 5, 3) for k in values], "scene_id long, raster_1 long, raster_2 long, height int, width int")
    px = spark.createDataFrame([(2 * k + r, y, x, float(v[r, y, x]), (k + y + x) % 7 != 0) for k, v in values.items() for r in (0, 1) for y in range(5) for x in range(3)], "raster_id long, y int, x int, b04 double, valid boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        scored = analysis.score_pairs(pairs, px, analysis.logistic_scorer(20.0), 4, ("b04",))
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
        got = {(r["scene_id"], r["y"], r["x"]): r["p"] for r in analysis.mosaic(scored, pairs).collect()}
        want = {(k, y, x): float(np.float32(analysis.logistic_scorer(20.0)(v[0][None], v[1][None])[y, x] if (k + y + x) % 7 else 0)) for k, v in values.items() for y in range(5) for x in range(3)}
        assert got == want

        rows = spark.range(400).selectExpr("id % 37 AS g", "CAST(id % 2 AS INT) AS h", "id AS v")
        total = lambda r: {"g": r["g"][:1], "n": np.array([len(r["v"])]), "s": r["v"].sum(keepdims=True)}
        sums = rows.groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("v").alias("s")).select("g", "n", "s")
        assert sorted(groups.map_groups(rows, ["g", "h"], total, "g long, n long, s long").collect()) == sorted(sums.collect())
        with pytest.raises(Exception, match="null in the keys"):
            groups.map_groups(rows.withColumn("g", F.expr("nullif(g, 3)")), ["g", "h"], total, "g long, n long, s long").collect()

        mask = scored.filter("p > 0.3").select("scene_id", "y", "x")
        assert sorted(components.label(mask, block=2).collect()) == sorted(components.label(mask).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mosaic_of_wide_grids(spark):
    """One place twice and its neighbour missing, on either side of a border of 64 columns."""
    pairs = spark.createDataFrame([(1, 2, 130)], "scene_id long, height int, width int")
    whole = spark.range(260).selectExpr("1L AS scene_id", "CAST(id div 130 AS INT) AS y", "CAST(id % 130 AS INT) AS x")
    assert analysis.mosaic(whole, pairs).count() == 260
    for twice, gone in ((63, 64), (64, 63), (5, 6), (127, 129)):
        with pytest.raises(ValueError, match="overlap or leave"):
            analysis.mosaic(whole.filter(f"NOT (y = 1 AND x = {gone})").union(whole.filter(f"y = 1 AND x = {twice}")), pairs)


# ------------------------------------------------------------------------------------------- pairs


def test_temporal_pairs(spark):
    base = header(1, "a", 10, (4, 4))
    other = [header(2, "a", 12, (4, 5), crs="EPSG:1", transform=[1.0], bounds=[1.0], band_count=3, dtypes="int16"), header(3, "a", 12, (4, 4), sensor="landsat"), header(4, "a", 10, (4, 4)), header(5, "b", 1, (4, 4)), header(6, "a", 25, (4, 4)) | {"crs": None}]
    rasters = headers_of(spark, [base, *other]).union(headers_of(spark, [header(7, "a", 1, (4, 4))]).withColumn("acquired", F.lit(None).cast("timestamp")))
    got = {(r["raster_1"], r["raster_2"]): r["reasons"] for r in catalog.temporal_pairs(rasters).collect()}
    assert len(got) == 10
    assert got[1, 2] == "crs,size,transform,bounds,band_count,dtypes,bands" and got[1, 3] == "sensor" and got[1, 4] == "same_time" and got[1, 6] == "no_crs,crs"
    near = {(r["raster_1"], r["raster_2"]) for r in catalog.temporal_pairs(rasters, within_days=2).collect()}
    assert near == {(1, 2), (1, 3), (1, 4), (4, 2), (4, 3), (2, 3)}
    both = [r for r in catalog.temporal_pairs(rasters, within_days=2, reversed_too=True).collect()]
    assert len(both) == 10 and ("a__20240112_20240110", 2, 1) in {(r["pair_id"], r["raster_1"], r["raster_2"]) for r in both}


def test_temporal_pairs_meet_once_for_both_orders(spark):
    """What a raster says by itself is not made anew for a pair, and one join gives both orders."""
    same = "'sentinel-2' AS sensor, 'c' AS crs, 1 AS width, 1 AS height, array(1.0D) AS transform, array(1.0D) AS bounds, 4 AS band_count, 'f' AS dtypes"
    rasters = spark.sql(f"SELECT id % 3 AS tile_id, concat('r', id) AS raster_id, timestamp_seconds(86400 * (id div 6)) AS acquired, {same} FROM range(60)")
    pairs = catalog.temporal_pairs(rasters, within_days=2, reversed_too=True)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.index("Join Inner") < plan.index("date_format")
    rows = pairs.collect()
    early = {(r["raster_1"], r["raster_2"]) for r in rows if r["acquired_1"] < r["acquired_2"]}
    assert early == {(b, a) for r in rows if r["acquired_1"] > r["acquired_2"] for a, b in [(r["raster_1"], r["raster_2"])]} and len(early) == 3 * 4 * (9 + 8)
    assert {r["reasons"] for r in rows} == {"", "same_time"} and all(r["pair_id"].startswith(f"{r['tile_id']}__197001") for r in rows)


def test_temporal_pairs_share_one_narrow_shuffle(spark):
    """Both sides of the join read one shuffle, in which a header is a few codes and a raster is held once, or twice near the start of a bin."""
    wide = "'s' AS sensor, 'c' AS crs, 1 AS width, 1 AS height, array(1.0D, id) AS transform, array(1.0D) AS bounds, 4 AS band_count, 'f' AS dtypes"
    rasters = spark.sql(f"SELECT id % 1 AS tile_id, id AS raster_id, timestamp_seconds(3600 * id) AS acquired, {wide} FROM range(480)")
    pairs = catalog.temporal_pairs(rasters, within_days=2, reversed_too=True).select("pair_id", "raster_1", "raster_2", "reasons")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("- Exchange ") == 1 and plan.count("- ReusedExchange ") == 1
    shared = next(x for x in plan.splitlines() if "ReusedExchange " in x)
    assert "_transform#" in shared and not any(f" {c}#" in shared for c in ("transform", "bounds", "crs", "sensor", "dtypes"))
    assert pairs.count() == 2 * (480 * 48 - 48 * 49 // 2) and {r["reasons"] for r in pairs.select("reasons").distinct().collect()} == {"transform"}


@pytest.mark.parametrize("within", [None, 0, 1, 3])
@pytest.mark.parametrize("reversed_too", [False, True])
def test_temporal_pairs_of_odd_headers(spark, within, reversed_too):
    """Against all pairs one by one: null headers, empty arrays and arrays of null, 0.0 and -0.0, not a number, times at the ends of bins and before 1970."""
    kinds = [None, [], [None], [0.0], [-0.0], [float("nan")], [1.0, 2.0], [1.0, None], [None, 1.0]]
    rows = []
    for k in range(72):
        seconds = -3 * 86400 + 14400 * (k % 48) + (k % 5 == 0) - (k % 7 == 0)
        sensor, crs = (None, "sentinel-2", "landsat")[k % 3], (None, "", "null")[k // 3 % 3]
        rows.append((k % 2 if k % 11 else None, f"r{k:02d}", None if k % 13 == 12 else seconds, sensor, crs, (None, 1, 2)[k % 3], (1, None)[k % 2], kinds[k % 9], kinds[k * 7 % 9], (None, 3, 4)[k // 2 % 3], (None, "a")[k // 4 % 2]))
    names = ["raster_id", "acquired", "sensor", "crs", "width", "height", "transform", "bounds", "band_count", "dtypes"]
    schema = "tile_id long, raster_id string, acquired long, sensor string, crs string, width int, height int, transform array<double>, bounds array<double>, band_count int, dtypes string"
    rasters = spark.createDataFrame(rows, schema).withColumn("acquired", F.timestamp_seconds("acquired"))
    plain = lambda v: None if v is None else [0.0 if x == 0 else "nan" if x is not None and x != x else x for x in v]
    want = []
    for a in rows:
        for b in rows:
            if a[0] is None or a[0] != b[0] or a[2] is None or b[2] is None or (within is not None and abs(a[2] - b[2]) > 86400 * within):
                continue
            if not (a[2] < b[2] or (a[2] == b[2] and a[1] < b[1]) or (reversed_too and a[2] > b[2])):
                continue
            x, y = (dict(zip(names, r[1:], strict=True)) for r in (a, b))
            bands = [v["band_count"] for v in (x, y) if v["band_count"] is not None]
            failed = [
                ("same_time", a[2] == b[2]), ("sensor", x["sensor"] != y["sensor"]), ("no_crs", x["crs"] is None or y["crs"] is None), ("crs", x["crs"] != y["crs"]),
                ("size", (x["width"], x["height"]) != (y["width"], y["height"])), ("transform", plain(x["transform"]) != plain(y["transform"])), ("bounds", plain(x["bounds"]) != plain(y["bounds"])),
                ("band_count", x["band_count"] != y["band_count"]), ("dtypes", x["dtypes"] != y["dtypes"]), ("bands", x["sensor"] == "sentinel-2" and min(bands, default=9) < 4),
            ]
            want.append((a[1], b[1], ",".join(n for n, c in failed if c), repr(plain(x["transform"])), x["height"]))
    found = catalog.temporal_pairs(rasters, within_days=within, reversed_too=reversed_too).collect()
    assert len(want) > 5 and sorted(map(repr, want)) == sorted(repr((r["raster_1"], r["raster_2"], r["reasons"], repr(plain(r["transform"])), r["height"])) for r in found)


def test_observation_products_join_each_side_first(spark):
    obs = spark.sql("SELECT id, IF(id % 2 = 0, 'T1', 'T2') AS role, id % 5 AS pair_id, IF(id % 7 = 0, 'a', 'b') AS sensor FROM range(40) WHERE id % 9 <> 0")
    first, second = spark.sql("SELECT IF(id % 8 <> 1, id, NULL) AS t1, id % 2 AS k FROM range(40)"), spark.sql("SELECT id AS t2, id % 2 AS k FROM range(45)")
    found = catalog.observation_products(first, second, ["k"], obs)
    want = catalog.observation_pairs(first.join(second, "k").select("t1", "t2"), obs)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 2 * 20 * 22 + 20
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 3 and "Join Inner, (k" in joins[0]


def test_observation_pairs(spark):
    obs = spark.createDataFrame([("x", "T1", "p", "s2"), ("y", "T2", "p", "s2"), ("z", "T2", "q", "s2"), ("w", "T2", "p", "ls")], "id string, role string, pair_id string, sensor string")
    asked = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z"), ("x", "w"), (None, "y"), ("x", "no")], "t1 string, t2 string")
    assert {(r["t1"], r["t2"]): r["reason"] for r in catalog.observation_pairs(asked, obs).collect()} == {("x", "y"): None, ("y", "x"): "role", ("x", "z"): "pair", ("x", "w"): "sensor", (None, "y"): "missing_id", ("x", "no"): "unknown_id"}


# --------------------------------------------------------------------------------- versions, caches


def test_store_survives_a_dead_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.read("a")
    first = store.commit({"a": spark.range(5), "b": spark.range(2)}, {"a": ["id"]})
    never = store.prepare({"a": spark.range(50)})
    assert store.current() == first and store.read("a").count() == 5
    (tmp_path / "store" / "version-00000001-half" / "a").mkdir(parents=True)  # a writer that died in the middle
    with pytest.raises(ValueError):
        store.publish("version-00000001-half")
    second = store.commit({"a": spark.range(7)})
    assert (store.read("a").count(), store.read("b").count(), store.read("a", first).count(), store.read("a", never).count()) == (7, 2, 5, 50)
    store.restore(first)
    assert store.read("a").count() == 5 and second in store.versions()
    storage.write_text(spark, str(tmp_path / "note"), "é")
    storage.write_text(spark, str(tmp_path / "note"), "two")
    assert storage.read_text(spark, str(tmp_path / "note")) == "two" and storage.read_text(spark, str(tmp_path / "none")) is None


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", [3.0, 4.0], "v1", "f"), ("b", [0.0, 0.0], "v1", "f"), ("c", [float("nan"), 1.0], "v1", "f"), ("d", [2.0, 0.0], "v1", "f")], "tile_id string, vector array<float>, model_version string, fingerprint string")
    cache.write(rows, path, "m")
    cache.write(rows.filter("tile_id = 'd'").withColumn("fingerprint", F.lit("g")), path, "m")
    held = cache.read(spark, path)
    assert {(r["tile_id"], tuple(round(x, 4) for x in r["vector"]), r["fingerprint"]) for r in held.collect()} == {("a", (0.6, 0.8), "f"), ("d", (1.0, 0.0), "g")}
    wanted = spark.createDataFrame([("a", "v1", 2, "f"), ("d", "v1", 2, "f"), ("b", "v1", 2, "f"), ("a", "v2", 2, "f"), ("a", "v1", 3, "f")], "tile_id string, model_version string, dimension int, fingerprint string")
    got = sorted((r["tile_id"], r["model_version"], r["dimension"], r["reason"]) for r in cache.usable(held, wanted, "m").filter("NOT hit").collect())
    assert got == [("a", "v1", 3, "dimension"), ("a", "v2", 2, "version"), ("b", "v1", 2, "absent"), ("d", "v1", 2, "fingerprint")]
    assert cache.usable(held, wanted, "other").filter("reason = 'model'").count() == 4


# ------------------------------------------------------------------------------------------ ingest


def land(spark, rows, path):
    spark.createDataFrame(rows, "tile_id string, words string, label int").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, state, encoder=None):
    stream = spark.readStream.schema("tile_id string, words string, label int").parquet(str(tmp_path / "in"))
    jobs.ingest(stream, str(tmp_path / "store"), str(tmp_path / state), encoder or embedding.hashed_encoder(8), "words", buckets=4).awaitTermination()
    return [(c["status"], c["count_before"], c["count_after"], c["failed"]) for c in jobs.commits(spark, str(tmp_path / "store"))]


def test_ingest(spark, tmp_path):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return embedding.hashed_encoder(8)(texts)

    land(spark, [("t1", "one", 1), ("t2", "two", 2), ("t2", "two", 2)], str(tmp_path / "in"))
    assert run(spark, tmp_path, "s") == [("success", 0, 2, 0)]
    assert run(spark, tmp_path, "s") == [("success", 0, 2, 0)]  # nothing has landed
    land(spark, [("t2", "two", 9), ("t3", "three", 3)], str(tmp_path / "in"))
    assert run(spark, tmp_path, "s") == [("success", 0, 2, 0), ("success", 2, 3, 0)]
    assert run(spark, tmp_path, "fresh-state")[2:] == [("already_indexed", 3, 3, 0)]
    land(spark, [("t4", "bad", 4)], str(tmp_path / "in"))
    assert run(spark, tmp_path, "s", picky)[3:] == [("failed", 3, 3, 1)]
    path = str(tmp_path / "store")
    index, names = jobs.read_ingested(spark, path, "index"), jobs.read_ingested(spark, path, "catalog")
    assert sorted(r["tile_id"] for r in index.collect()) == ["t1", "t2", "t3"] and {r["tile_id"]: r["label"] for r in names.collect()} == {"t1": 1, "t2": 2, "t3": 3}
    assert jobs.ingest_report(spark, path).agg(F.sum("added")).first()[0] == 3


def test_ingest_dies_before_its_commit(spark, tmp_path):
    land(spark, [("t1", "one", 1)], str(tmp_path / "in"))
    run(spark, tmp_path, "s")
    commit = next((tmp_path / "store" / "commits").glob("*.json"))
    name = json.loads(commit.read_text())["batch"]
    for leftover in (commit, *(tmp_path / "s" / "commits").glob("*"), *(tmp_path / "s" / "commits").glob(".*")):
        if leftover.is_file():
            leftover.unlink()  # the batch was written, its commits were not
    assert jobs.read_ingested(spark, str(tmp_path / "store"), "index") is None
    assert run(spark, tmp_path, "s") == [("success", 0, 1, 0)]
    assert json.loads(commit.read_text())["batch"] == name and jobs.read_ingested(spark, str(tmp_path / "store"), "index").count() == 1


# -------------------------------------------------------------------------------------- projection


def test_utm_round_trip(spark):
    d = spark.range(3000).select((F.col("id") % 161 - 80 + 0.3).alias("lat"), (F.col("id") * 7 % 360 - 180 + 0.25).alias("lng"))
    d = d.withColumn("zone", (F.floor((F.col("lng") + 180) / 6) + 1).cast("int")).withColumn("north", F.col("lat") >= 0)
    d = d.withColumn("m", geo.utm(F.col("lat"), F.col("lng"), F.col("zone"), F.col("north"))).withColumn("b", geo.from_utm(F.col("m.easting"), F.col("m.northing"), F.col("zone"), F.col("north")))
    far = d.select(F.max(F.abs(F.col("b.lat") - F.col("lat"))).alias("a"), F.max(F.abs(F.col("b.lng") - F.col("lng"))).alias("o")).first()
    assert far["a"] < 1e-9 and far["o"] < 1e-9
    # The meridian of a zone meets the equator at its false easting.
    at = spark.range(1).select(geo.utm(F.lit(0.0), F.lit(3.0), F.lit(31), F.lit(True)).alias("m")).first()["m"]
    assert (at["easting"], at["northing"]) == (pytest.approx(500000.0, abs=1e-6), pytest.approx(0.0, abs=1e-6))


def test_bounds_take_the_edges(spark):
    box = F.array(*map(F.lit, (500000.0 - 200000, 5000000.0, 700000.0, 5200000.0)))
    row = spark.range(1).select(geo.degree_bounds(box, F.lit(31), F.lit(True)).alias("d"), geo.utm_bounds(F.array(*map(F.lit, (0.0, 50.0, 6.0, 52.0))), F.lit(31), F.lit(True)).alias("m")).first()
    corner = spark.range(1).select(geo.from_utm(F.lit(300000.0), F.lit(5200000.0), F.lit(31), F.lit(True)).alias("c"), geo.from_utm(F.lit(500000.0), F.lit(5200000.0), F.lit(31), F.lit(True)).alias("e")).first()
    assert row["d"][3] == pytest.approx(corner["e"]["lat"], abs=1e-4) and row["d"][3] > corner["c"]["lat"] + 1e-3
    assert row["m"][0] == pytest.approx(1e6 - row["m"][2], abs=1e-3)


# ----------------------------------------------------------------------------------------- ledgers


def test_bounds_of_many_boxes_are_arrays(spark):
    """Boxes are projected a batch at a time, not point by point in interpreted functions; a box without a zone or a bound has no extent."""
    d = spark.range(3000).select("id", F.array(*(F.lit(v) + F.col("id") % 50 for v in (0.0, 10.0, 1.0, 11.0))).alias("box"), F.when(F.col("id") != 7, 31).alias("zone"))
    d = d.withColumn("box", F.when(F.col("id") != 8, F.col("box"))).select("id", "box", geo.utm_bounds("box", "zone", F.lit(True)).alias("m"))
    assert "ArrowEvalPython" in d._jdf.queryExecution().executedPlan().toString()
    rows = {r["id"]: r for r in d.collect()}
    assert rows[7]["m"] == rows[8]["m"] == [None] * 4 and len(rows) == 3000
    corner = spark.range(1).select(geo.utm(F.lit(10.0), F.lit(0.0), F.lit(31), F.lit(True)).alias("c")).first()["c"]
    assert abs(rows[2950]["m"][0] - corner["easting"]) < 1e-6 and rows[0]["m"] == rows[2950]["m"]


def test_hashes_by_columns_equal_those_by_code(spark):
    from skylattice.operators import ledger

    odd = ["plain", "", None, 'q"uote', "back\\slash", "tab\t nl\n cr\r \b\f", "\x00\x1f\x0b\x7f", "é ß 日本", "🙂 𝒳", '{"a": 1}']
    rows = [(k % 2, k // 2 + 1, f"2024-01-01T00:00:{k:02d}", f"A{k}é", d) for k, d in enumerate(odd)]
    events = spark.createDataFrame(rows, "ledger_id long, seq long, stamp string, action string, detail string").repartition(3)
    for link in ("sha256", "fnv1a"):
        chain = ledger.append_chain(events, link)
        assert {r["status"] for r in ledger.verify_chain(chain, link).collect()} == {"intact"}
        wrong = chain.withColumn("detail", F.when((F.col("ledger_id") == 1) & (F.col("seq") == 3), "x").otherwise(F.col("detail")))
        assert {(r["ledger_id"], r["seq"]) for r in ledger.verify_chain(wrong, link).filter("status = 'broken'").collect()} == {(1, 3), (1, 4), (1, 5)}
        loose = chain.filter("NOT (ledger_id = 0 AND seq = 2)")
        assert {(r["ledger_id"], r["seq"]) for r in ledger.verify_chain(loose, link).filter("status = 'broken'").collect()} == {(0, 3), (0, 4), (0, 5)}
    # Published values of FNV-1a.
    values = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(F.hex(ledger.fnv1a(F.col("t"))).alias("h"))
    assert [r["h"] for r in values.collect()] == ["811C9DC5", "E40C292C", "BF9CF968"]


# ------------------------------------------------------------------------------- sums and quantiles


def test_running_sums_and_quantiles(spark):
    from skylattice.operators.ranking import quantiles, running_sums

    draw = np.random.default_rng(3)
    rows = [(None if g == 2 else g, float(v), int(n)) for g in range(3) for v, n in zip(draw.permutation(200 if g else 2000), draw.integers(0, 5, 2000), strict=False)]
    df = spark.createDataFrame(rows, "g int, v double, n long").repartition(7)
    got = {(r["g"], r["v"]): r["n_upto"] for r in running_sums(df, ["g"], "v", ["n"]).collect()}
    want = {}
    for g in (0, 1, None):
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            total += n
            want[g, v] = total
    assert got == want
    values = spark.createDataFrame([(g, None if k % 9 == 0 else float(k * 7 % 50)) for g in "ab" for k in range(300 if g == "a" else 2)], "g string, v double")
    found = {r["g"]: (r["n"], r["q"]) for r in quantiles(values, ["g"], "v", [0, 0.1, 0.5, 0.99, 1]).collect()}
    for g, n in (("a", 300), ("b", 2)):
        held = [float(k * 7 % 50) for k in range(n) if k % 9]
        assert found[g][0] == len(held) and np.allclose(found[g][1], np.quantile(held, [0, 0.1, 0.5, 0.99, 1]))


def test_evaluation_levels(spark):
    from skylattice.operators import metrics

    rows = [(k % 2, k % 4, (k * 37 % 100) / 100, int(k % 3 == 0) if k % 4 else 0) for k in range(400)]
    df = spark.createDataFrame(rows, "fold int, location int, p double, truth int").withColumn("p", F.col("p").cast("float"))
    swept, summary = (x.collect() for x in metrics.evaluation_job(df, [0.25, 0.5]))
    assert {(r["level"], r["fold"], r["location"]) for r in summary} == {("location", k % 2, k) for k in range(4)} | {("fold", 0, None), ("fold", 1, None), ("pooled", None, None)}
    assert len(swept) == 14
    for r in swept:
        held = [x for x in rows if r["fold"] in (None, x[0]) and r["location"] in (None, x[1])]
        hit = [np.float32(x[2]) >= np.float32(r["threshold"]) for x in held]
        assert (r["tp"], r["fp"]) == (sum(h and x[3] for h, x in zip(hit, held, strict=True)), sum(h and not x[3] for h, x in zip(hit, held, strict=True)))
    lone = next(r for r in summary if r["location"] == 0)
    assert lone["auc"] is None and lone["mean_pos"] is None


# ------------------------------------------------------------------------------------------ search


def test_block_products_equal_brute_force(spark, monkeypatch):
    from skylattice.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 7)
    draw = np.random.default_rng(9)
    held = [(f"t{k:03d}", "abc"[k % 3] if k % 10 else None, [float(x) for x in draw.integers(-2, 3, 4)]) for k in range(120)]
    held += [("zero", "a", [0.0] * 4), ("short", "a", [1.0, 2.0]), ("none", "b", None), ("bad", "b", [float("nan"), 0.0, 0.0, 1.0])]
    tiles = spark.createDataFrame(held, "tile_id string, sensor string, vector array<double>").repartition(5)
    asked = [(k, held[k * 11][2]) for k in range(10)] + [(99, [0.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id int, query array<double>")

    def scores(query, of):
        q, out = np.array(query), []
        for t, s, v in of:
            if v is None or len(v) != 4 or not np.isfinite(v).all() or not np.linalg.norm(v) or not np.linalg.norm(q):
                continue
            out.append((round(float(np.clip(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q), -1, 1)), 6), t))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    got = sorted((r["query_id"], r["rank"], r["tile_id"]) for r in retrieval.top_k(tiles, queries, 6).collect())
    assert got == sorted((k, i + 1, t) for k, q in asked for i, (_, t) in enumerate(scores(q, held)[:6]))
    got = sorted((r["query_id"], r["rank"], r["tile_id"]) for r in retrieval.per_sensor(tiles, queries, 3).collect())
    want = []
    for k, q in asked:
        merged = [x for s in ("a", "b", "c", None) for x in scores(q, [h for h in held if h[1] == s])[:3]]
        want += [(k, i + 1, t) for i, (_, t) in enumerate(sorted(merged, key=lambda x: (-x[0], x[1]))[:3])]
    assert got == sorted(want)
    assert retrieval.top_k(tiles.limit(0), queries, 3).count() == 0 and retrieval.top_k(tiles, queries.limit(0), 3).count() == 0
