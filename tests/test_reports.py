"""Searches, reports and exports on small tables worked out by hand or by brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import catalog, change, raster, reports, retrieval
from skylattice.sources import manifests, sinks


def test_threshold_search_and_ranks(spark):
    draw = np.random.default_rng(8)
    vecs = draw.normal(size=(40, 4))
    tiles = spark.createDataFrame([(f"T{k:02d}", [float(x) for x in v]) for k, v in enumerate(vecs)] + [("T98", [0.0] * 4), ("T99", None)], "tile_id string, vector array<double>")
    asked = tiles.filter("tile_id IN ('T00', 'T01')").select(F.col("tile_id").alias("query_id"), F.col("vector").alias("query"))
    got = {}
    for r in retrieval.ranked(retrieval.block_hits(tiles, asked, least=0.2)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["tile_id"], r["score"]))
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    for q in (0, 1):
        score = np.round(unit @ unit[q], 6)
        want = sorted(((-s, f"T{k:02d}") for k, s in enumerate(score) if s >= 0.2))
        assert [(k, t) for k, t, _ in sorted(got[f"T{q:02d}"])] == [(k + 1, t) for k, (_, t) in enumerate(want)]
    assert retrieval.ranked(retrieval.block_hits(tiles.limit(0), asked, least=0.2)).count() == 0


def test_ranks_store_a_hit_once(spark, monkeypatch):
    """Ranks come from the place in a sorted partition: no window over the hits, ties by tile_id, a query over many partitions."""
    hits = spark.range(3000).select((F.col("id") % 2).alias("query_id"), F.concat(F.lit("t"), F.col("id")).alias("tile_id"), (F.col("id") % 7 / 10).alias("score"))
    want = {}
    for q in (0, 1):
        order = sorted(((-(i % 7) / 10, f"t{i}") for i in range(3000) if i % 2 == q))
        want |= {(q, t): k for k, (_, t) in enumerate(order, 1)}
    for most in (retrieval.MAX_STARTS, 1):
        monkeypatch.setattr(retrieval, "MAX_STARTS", most)
        found = retrieval.ranked(hits)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["query_id"], r["tile_id"]): r["rank"] for r in found.collect()} == want


def test_clusters_send_a_matrix_once_for_two_chunks(spark):
    """Each block goes once to each pair of chunks, not to each pair of blocks."""
    tiles = spark.range(160).select(F.concat(F.lit("t"), F.lpad(F.col("id"), 3, "0")).alias("tile_id"), F.array(F.cos(F.col("id") / 20), F.sin(F.col("id") / 20)).alias("vector"))
    blocks, width = retrieval.metric_blocks(tiles, 2, 8)
    pairs = retrieval.near_blocks(blocks, width, 4.0)
    met = retrieval._met(pairs, blocks, retrieval._count_near(-1.0), "tile_id string, n long", chunk=4)
    found = {r[0]: r[1] for r in met.groupBy("tile_id").agg(F.sum("n")).collect()}
    n = blocks.count()
    assert n >= 20 and pairs.count() == n * (n + 1) // 2 and len(found) == 160 and set(found.values()) == {160}
    size = min(4, -(-n // 8))
    assert met.count() <= 160 * -(-n // size) < 160 * n // 2


@pytest.mark.parametrize(("hub", "parts", "least", "min_points", "spread"), [(48, 8, 0.7, 3, 0.25), (48, 1, 0.8, 4, 0.3), (8, 8, 0.35, 1, 1.0), (400, 2, 0.9, 3, 0.15)])
def test_clusters_with_a_hub(spark, monkeypatch, hub, parts, least, min_points, spread):
    """Hubs of all sizes against all pairs: groups, some joined by a bridge, border tiles, noise, copies, vectors of another length."""
    monkeypatch.setattr(retrieval, "HUB", hub, raising=False)
    monkeypatch.setattr(retrieval, "PARTS", parts, raising=False)
    draw = np.random.default_rng(12)
    centres = np.eye(8)[:4]
    vecs = [centres[k % 4] + spread * draw.normal(size=8) for k in range(240)] + [np.cos(t) * centres[0] + np.sin(t) * centres[1] for t in np.linspace(0, np.pi / 2, 9)]
    vecs += list(draw.normal(size=(20, 8))) + [centres[2]] * 20 + [np.array([1.0, k, 0.0]) for k in (0.0, 0.0, 0.1, 9.0)]
    order = draw.permutation(len(vecs))
    vecs = [vecs[k] / np.linalg.norm(vecs[k]) for k in order]
    near = [[j for j, v in enumerate(vecs) if len(v) == len(u) and round(float(np.clip(u @ v, -1, 1)), 6) >= least] for u in vecs]
    label = {i: i for i, n in enumerate(near) if len(n) >= min_points}
    core = set(label)
    while (new := {i: min(label[j] for j in near[i] if j in core) for i in core}) != label:
        label = new
    places = [i if i in core else min((j for j in near[i] if j in core), default=None) for i in range(len(vecs))]
    want = {f"T{i:03d}": None if at is None else f"T{label[at]:03d}" for i, at in enumerate(places)}
    tiles = spark.createDataFrame([(f"T{k:03d}", [float(x) for x in v]) for k, v in enumerate(vecs)], "tile_id string, vector array<double>").repartition(3)
    assert {r["tile_id"]: r["cluster"] for r in retrieval.clusters(tiles, least, min_points, pivots=4, block=16).collect()} == want


def test_clusters_of_a_dense_table_meet_few_blocks(spark, monkeypatch):
    """At a wide angle no pivot tells blocks apart: cores that hang together are not compared pair by pair."""
    monkeypatch.setattr(retrieval, "HUB", 64, raising=False)
    tiles = spark.range(640).select(F.concat(F.lit("t"), F.lpad(F.col("id"), 3, "0")).alias("tile_id"), F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("vector"))
    seen, met = [], retrieval._met

    def counted(pairs, blocks, *more):
        seen.append((pairs.count(), blocks.count()))
        return met(pairs, blocks, *more)

    monkeypatch.setattr(retrieval, "_met", counted)
    assert {r["cluster"] for r in retrieval.clusters(tiles, 0.35, 3, pivots=4, block=16).collect()} == {"t000"}
    assert len(seen) == 2 and all(n >= 40 and pairs <= n for pairs, n in seen)


def test_block_products_hold_a_batch_of_tiles(spark):
    """Blocks of tiles and queries do not travel as pairs of matrices: a row that goes to Python is one vector."""
    tiles = spark.range(50).select(F.concat(F.lit("t"), F.col("id")).alias("tile_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vector"))
    found = retrieval.block_hits(tiles, tiles.limit(3).select(F.col("tile_id").alias("query_id"), F.col("vector").alias("query")), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_like_seeds(spark):
    rows = [("a", "n", [1.0, 0.0]), ("b", "n", [1.0, 0.0]), ("c", "n", [0.0, 1.0]), ("d", "s", [1.0, 0.0]), ("e", None, [1.0, 0.0])]
    tiles = spark.createDataFrame(rows, "tile_id string, region string, vector array<double>")
    seeds = tiles.filter("tile_id IN ('a', 'e')").select(F.col("tile_id").alias("query_id"), F.col("vector").alias("query"), F.col("tile_id").alias("own"), "region")
    assert [(r["query_id"], r["rank"], r["tile_id"], r["score"]) for r in retrieval.like_seeds(tiles, seeds, 5, "region", "own").orderBy("rank").collect()] == [("a", 1, "b", 1.0), ("a", 2, "c", 0.0)]
    assert [r["tile_id"] for r in retrieval.like_seeds(tiles, seeds, 1, "region", "own").collect()] == ["b"]


def test_timeline(spark):
    rows = [("s2", "b", "2020-01-01"), ("s2", "a", "2020-01-01"), ("s2", "c", "2020-01-05"), ("s2", "d", "2020-01-02"), ("s1", "e", "2020-03-01"), (None, "f", "2020-01-01"), (None, "g", "2020-01-03"), ("s2", "h", None)]
    scenes = spark.createDataFrame(rows, "sensor string, scene_id string, day string").withColumn("acquired", F.to_timestamp("day"))
    got = sorted((str(r["sensor"]), r["rank"], r["scene_id"], r["place"]) for r in catalog.timeline(scenes, "sensor").collect())
    assert got == [("None", 1, "f", 0.0), ("None", 2, "g", 1.0), ("s1", 1, "e", 0.5), ("s2", 1, "a", 0.0), ("s2", 2, "b", 0.0), ("s2", 3, "d", 0.25), ("s2", 4, "c", 1.0)]


def test_sampled_statistics_with_masked_pixels(spark):
    grid = {(y, x): float(10 * y + x) for y in range(6) for x in range(6)}
    grid[0, 0], grid[2, 2], grid[5, 5] = None, float("nan"), float("inf")
    px = spark.createDataFrame([(1, y, x, v) for (y, x), v in grid.items()] + [(2, 0, 0, None)], "scene_id long, y int, x int, value double")
    got = {r["scene_id"]: r for r in raster.sampled_statistics(px, 6, 6, 3, 3).collect()}
    counted = [grid[y + dy, x + dx] for y in (0, 1, 3) for x in (0, 1, 3) for dy in range(3) for dx in range(3)]
    valid = [v for v in counted if v is not None and np.isfinite(v)]
    r = got[1]
    assert (r["low"], r["high"], r["n"]) == (min(valid), max(valid), 81)
    assert r["mean"] == pytest.approx(np.mean(valid), abs=1e-6) and r["valid_fraction"] == pytest.approx(len(valid) / 81, abs=1e-6)
    assert (got[2]["mean"], got[2]["valid_fraction"]) == (None, 0.0)


def test_pair_similarity_and_channel_values(spark):
    draw = np.random.default_rng(3)
    a, b = draw.uniform(0, 9, size=(2, 3, 25)).round(1)
    a[0, 0] = 0.0
    rows = [(1, f"c{c}", k, 0, float(a[c, k]), float(b[c, k])) for c in range(3) for k in range(25)] + [(1, "c0", 25, 0, float("nan"), 1.0), (1, "c0", 26, 0, None, 0.0)]
    long = spark.createDataFrame(rows, "pair_id long, channel string, y int, x int, a double, b double").repartition(3)
    r = raster.pair_similarity(long).first()
    nd = ((b - a) / (abs(a) + abs(b) + 1e-8)).ravel()
    pearson = [np.corrcoef(a[c], b[c])[0, 1] for c in range(3)]
    want = {
        "pearson_median": np.median(pearson), "pearson_low": min(pearson), "pearson_high": max(pearson), "mae_median": np.median(abs(b - a).mean(1)),
        "relative_mae": abs(b - a).mean() / ((abs(a) + abs(b)) / 2).mean(), "nd_low": nd.min(), "nd_high": nd.max(), "nd_mean": nd.mean(), "nd_median": np.median(nd),
        "nd_p90": np.percentile(nd, 90), "nd_p95": np.percentile(nd, 95), "nd_p99": np.percentile(nd, 99), "over_half": (abs(nd) >= 0.5).mean(), "over_08": (abs(nd) >= 0.8).mean(),
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value, abs=2e-6), name
    side = {(x["channel"], x["side"]): x for x in raster.channel_values(long).collect()}
    assert side["c0", "a"]["finite_share"] == pytest.approx(25 / 27, abs=1e-6) and side["c0", "a"]["zero_share"] == pytest.approx((a[0] == 0).sum() / 27, abs=1e-6)
    assert side["c2", "b"]["median"] == pytest.approx(np.median(b[2])) and side["c2", "b"]["p99"] == pytest.approx(np.percentile(b[2], 99), abs=1e-6)
    values = spark.createDataFrame([(1, v % 50) for v in range(200)] + [(1, None), (2, 3)], "g int, v int")
    assert {x["g"]: x["values"] for x in raster.distinct_values(values, "g", "v", 32).collect()} == {1: list(range(32)), 2: [3]}


def test_visual_change(spark):
    rows = []
    for y in range(40):
        for x in range(40):
            hit = (y < 10 and x < 20) or (y >= 30 and x >= 30 and (y + x) % 3 == 0) or (20 <= y < 30 and x < 10 and x % 10 < 3)
            rows.append((7, y, x, 0, 0, 0, 90 if hit else 0, 30, 60 if hit else 3))
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, r int, g int, b int, r2 int, g2 int, b2 int")
    d = change.pixel_distance(px, px.select("scene_id", "y", "x", F.col("r2").alias("r"), F.col("g2").alias("g"), F.col("b2").alias("b")), ("r", "g", "b"))
    clusters = change.block_clusters(d)
    # Two blocks side by side, and one with a third of its pixels; exactly 30 of 100 is not enough.
    assert [tuple(r) for r in clusters.orderBy("rank").collect()] == [(7, 1, 2, 0, 0, 0, 1), (7, 2, 1, 3, 3, 3, 3)]
    dates = spark.createDataFrame([(7, "2024-03-10", "2024-03-01")], "scene_id long, a string, b string").select("scene_id", F.to_timestamp("a").alias("before"), F.to_timestamp("b").alias("after"))
    n = sum(r[6] == 90 for r in rows)
    similarity = 100 - (n * 60 + (1600 - n) * 11) / 1600 / 255 * 100
    assert tuple(change.visual_report(d, clusters, dates).first()) == (7, round(n / 16, 1), round(similarity, 1), 9, 2)
    none = change.visual_report(d, clusters.limit(0), dates.limit(0)).first()
    assert (none["days"], none["regions"]) == (None, 0)


def test_resolve_tiles(spark, tmp_path):
    for k, (folder, paths) in enumerate({"a": ["x/one.tif", "two.tif", "gone.tif"], "b/c": ["/abs/three.tif", "x/one.tif"]}.items()):
        at = tmp_path / "m" / folder
        at.mkdir(parents=True)
        (at / "tiles.json").write_text(json.dumps({"source": f"s{k}", "tiles": [{"path": p, "valid_fraction": 0.5} for p in paths]}, indent=1))
    for f in ("base/x/one.tif", "m/a/two.tif", "m/a/one.tif"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("tile")
    (tmp_path / "m/a/gone.tif").write_text("")  # a file without content is no tile
    files = manifests.list_files(spark, str(tmp_path), "*.tif").union(spark.createDataFrame([("/abs/three.tif",)], "file string"))
    got = {r["file"]: (r["source"], r["how"]) for r in manifests.resolve_tiles(manifests.read_manifests(spark, str(tmp_path / "m")), files, str(tmp_path / "base")).collect()}
    assert got == {f"{tmp_path}/base/x/one.tif": ("s1", "below"), f"{tmp_path}/m/a/two.tif": ("s0", "beside"), "/abs/three.tif": ("s1", "absolute")}
    (tmp_path / "m" / "bad").mkdir()
    (tmp_path / "m" / "bad" / "tiles.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        manifests.read_manifests(spark, str(tmp_path / "m")).collect()


def test_bundles(spark, tmp_path):
    timeline = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (2, 5, None)], "case long, at int, what string")
    review = spark.createDataFrame([(1, 9, "ok")], "case long, at int, what string")
    lines = reports.bundle({"timeline": timeline, "review": review, "evidence": timeline.limit(0)}, "case", {"timeline": "at", "review": "at", "evidence": "at"})
    sinks.write_bundles(lines, "case", str(tmp_path / "b"))
    got = sorted((r["case"], r["part"], r["seq"], json.loads(r["body"])["what"]) for r in sinks.read_bundles(spark, "case", "long", str(tmp_path / "b")).collect())
    assert got == [(1, "review", 1, "ok"), (1, "timeline", 1, "a"), (1, "timeline", 2, "a"), (1, "timeline", 3, "b"), (2, "timeline", 1, None)]
