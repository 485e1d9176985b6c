"""Small hand-computed cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, pixels, times, vectors
from skylattice.operators import catalog, clipping, components, focal, ledger, metrics, raster, retrieval, training
from skylattice.sources import aoi, arrays, manifests
from skylattice.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def grid(spark, rows):
    """Pixels of a picture of numbers as scene 1."""
    return spark.createDataFrame([(1, y, x, float(v)) for y, line in enumerate(rows) for x, v in enumerate(line)], "scene_id long, y int, x int, v double")


def test_fusion_goldens(spark):
    cases = [(0.9861, 0.5759, 1.0, "HIGH AGREEMENT"), (0.20, 0.60, 1.0, "SAR-ONLY"), (0.85, 0.30, 1.0, "OPTICAL-ONLY"), (0.15, 0.20, 1.0, "NO STRONG EVIDENCE")]
    for o, s, q, label in cases:
        row = one(spark, pixels.fusion_label(F.lit(o), F.lit(s)).alias("l"), pixels.fusion_score(F.lit(o), F.lit(s), F.lit(q)).alias("v"))
        assert row["l"] == label
    assert one(spark, pixels.fusion_score(F.lit(0.9861), F.lit(0.5759), F.lit(1.0)).alias("v"))["v"] == pytest.approx(84.7, abs=0.2)


def test_masks(spark):
    rows = spark.range(12).select("id", pixels.scl_valid(F.col("id").cast("int")).alias("v")).collect()
    assert {r["id"] for r in rows if not r["v"]} == {0, 1, 3, 8, 9, 10, 11}
    bits = spark.range(16).select("id", pixels.qa_valid(F.pow(F.lit(2), "id").cast("int")).alias("v")).collect()
    assert {r["id"] for r in bits if not r["v"]} == set(range(6))
    with pytest.raises(Exception, match="no quality mask"):
        spark.range(1).select(pixels.quality_valid(F.lit("modis"), F.lit(1))).collect()


def test_float_threshold(spark):
    row = one(spark, pixels.threshold_mask(F.lit(0.96).cast("float"), 0.96).alias("m"))
    assert row["m"] == 1


def test_rounding_is_half_even(spark):
    row = one(spark, pixels.to_uint8(F.lit(0.5 / 255)).alias("a"), pixels.to_uint8(F.lit(1.5 / 255)).alias("b"), pixels.to_uint8(F.lit(float("nan"))).alias("c"), pixels.to_uint8(F.lit(float("inf"))).alias("d"))
    assert (row["a"], row["b"], row["c"], row["d"]) == (0, 2, 0, 255)


def picture(spark, lines):
    return spark.createDataFrame([(1, y, x) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"], "scene_id long, y int, x int")


SHAPES = ["##...#..#", "..#..#...", "#....####", "##..#....", ".#.#..###", "..#...#.#", "......###"]


@pytest.mark.parametrize("block", [2, 3, 5, 256])
def test_labels_do_not_depend_on_blocks(spark, block):
    mask = picture(spark, SHAPES)
    whole = components.label(mask, block=256).collect()
    assert sorted(components.label(mask, block=block).collect()) == sorted(whole)
    assert len({r["root"] for r in whole}) == 5 - 1


def test_labels_4_connected(spark):
    assert components.label(picture(spark, ["#.", ".#"]), diagonal=False).select("root").distinct().count() == 2
    assert components.label(picture(spark, ["#.", ".#"])).select("root").distinct().count() == 1


def test_closing_fills_a_hole_and_loses_the_border(spark):
    found = components.closing(picture(spark, [".......", ".......", "..###..", "..#.#..", "..###..", ".......", "......."]), 7, 7)
    assert {(r["y"], r["x"]) for r in found.collect()} == {(y, x) for y in (2, 3, 4) for x in (2, 3, 4)}
    assert components.closing(picture(spark, ["###", "###", "###"]), 3, 3).collect() == [(1, 1, 1)]


def test_candidates_of_two_squares(spark):
    p = {(y, x): 0.97 for y in (1, 2) for x in (1, 2)} | {(y, x): 0.99 for y in (4, 5) for x in (5, 6)}
    rows = [(1, y, x, p.get((y, x), 0.1), True) for y in range(8) for x in range(9)]
    px = spark.createDataFrame(rows, "scene_id long, y int, x int, p float, valid boolean").withColumn("p", F.col("p").cast("float"))
    labels = components.numbered(components.label(px.filter(F.col("p") >= F.lit(0.96).cast("float"))))
    judged = components.rejected(components.candidates(labels, px, 0.96, 8, 9), True)
    ranked = {r["rank"]: r for r in components.ranked(judged, F.col("mean_p")).collect()}
    assert (ranked[1]["area"], round(ranked[1]["mean_p"], 2)) == (4, 0.99)
    assert (ranked[1]["xmin"], ranked[1]["ymin"], ranked[1]["xmax"], ranked[1]["ymax"]) == (5, 4, 7, 6)
    counts = components.accounting(judged).first()
    assert (counts["removed_components"], counts["retained_components"], counts["removed_pixels"], counts["retained_pixels"]) == (0, 2, 0, 8)


def test_confusion_and_auc(spark):
    cells = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 0, 1), (1, 0, 0)], "scene_id long, pred int, truth int")
    r = metrics.scores(metrics.confusion(cells, "scene_id")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert r["iou"] == pytest.approx(1 / 3, abs=1e-6) and r["predicted_pct"] == 50
    scored = spark.createDataFrame([(1, 0.1, 0), (1, 0.2, 0), (1, 0.8, 1), (1, 0.9, 1), (2, 0.5, 0), (2, 0.5, 0), (2, 0.5, 1), (2, 0.5, 1), (3, 0.5, 1)], "scene_id long, score double, label int")
    found = {r["scene_id"]: (r["auc"], r["average_precision"]) for r in metrics.discrimination(scored, "scene_id").collect()}
    assert found == {1: (1.0, 1.0), 2: (0.5, 0.5), 3: (None, None)}


def test_best_threshold_prefers_the_higher(spark):
    swept = spark.createDataFrame([(1, 0.25, 0.5), (1, 0.5, 0.5), (1, 0.75, 0.4)], "scene_id long, threshold double, f1 double")
    assert metrics.best_threshold(swept, "scene_id").first()["threshold"] == 0.5


def test_date_bounds(spark):
    rows = spark.createDataFrame([("a", "2025-03-29 23:59:59.5"), ("b", "2025-03-30 00:00:00"), ("c", None)], "k string, t string").withColumn("t", F.to_timestamp("t"))
    got = lambda start, end: {r["k"] for r in rows.filter(times.in_range(F.col("t"), start, end)).collect()}
    assert got("2025-03-29", "2025-03-29") == {"a"}
    assert got(None, None) == {"a", "b", "c"}
    assert got("2025-03-30", None) == {"b"}


def test_sensor_names():
    assert catalog.sensor_names(["S2", " landsat ", "sentinel2"]) == ["sentinel-2", "landsat"]
    with pytest.raises(ValueError):
        catalog.sensor_name("modis")
    with pytest.raises(ValueError):
        geo.check_box([4, 3, 2, 1])


def test_utm(spark):
    m = one(spark, geo.utm(F.lit(0.0), F.lit(3.0), F.lit(31)).alias("m"))["m"]
    assert (m["easting"], m["northing"]) == pytest.approx((500000.0, 0.0), abs=1e-3)
    m = one(spark, geo.utm(F.lit(43.642567), F.lit(-79.387139), F.lit(17)).alias("m"))["m"]
    assert (m["easting"], m["northing"]) == pytest.approx((630084, 4833438), abs=1.5)


def test_affine(spark):
    t = F.array(*map(F.lit, (10.0, 0.0, 100.0, 0.0, -10.0, 900.0)))
    r = one(spark, geo.pixel_of(t, F.lit(125.0), F.lit(870.0)).alias("p"), geo.pixel_area(t, F.lit(None).cast("double")).alias("a"))
    assert (r["p"]["x"], r["p"]["y"], r["a"]) == (2.5, 3.0, None)


def test_vectors(spark):
    r = one(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vectors.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z"))
    assert r["u"] == pytest.approx([0.6, 0.8]) and r["z"] is None


def test_search(spark):
    tiles = spark.createDataFrame([("tile-0", [1.0, 0.0]), ("tile-1", [0.8, 0.6]), ("tile-2", [0.0, 1.0]), ("tile-3", [0.0, 0.0])], "tile_id string, vector array<float>")
    queries = spark.createDataFrame([(1, [10.0, 0.0]), (2, [0.0, 3.0])], "query_id long, query array<float>")
    hits = retrieval.top_k(tiles, queries, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["tile_id"]) for r in hits] == [(1, "tile-0"), (1, "tile-1"), (1, "tile-2"), (2, "tile-2"), (2, "tile-1"), (2, "tile-0")]


def test_merge(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("a", 3), ("a", 4), ("c", 5)], "k string, v int")
    assert dict(catalog.merge_actions(old, new, "k", ["v"], "v").collect()) == {"a": "update", "b": "same", "c": "add"}
    assert dict(catalog.merge(old, new, "k", "v").collect()) == {"a": 4, "b": 2, "c": 5}
    assert catalog.insert_absent(old, new, "k", "v").collect() == [("c", 5)]


def test_chain_breaks_at_a_changed_row(spark):
    rows = [(1, k, f"t{k}", "NOTE", "é\"x" if k == 2 else None) for k in range(1, 6)]
    chain = ledger.append_chain(spark.createDataFrame(rows, "ledger_id long, seq long, stamp string, action string, detail string"))
    assert {r["status"] for r in ledger.verify_chain(chain).collect()} == {"intact"}
    bad = chain.withColumn("action", F.when(F.col("seq") == 3, "FORGED").otherwise(F.col("action")))
    assert [r["status"] for r in ledger.verify_chain(bad).orderBy("seq").collect()] == ["intact"] * 2 + ["broken"] * 3


def test_replay_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.sql("SELECT id % 2 AS candidate_id, id AS seq, IF(id = 5, 'confirmed', 'pending') AS decision FROM range(12)").mapInArrow(count, "candidate_id long, seq long, decision string")
    found = jobs.replay(spark, rows, str(tmp_path / "once"), jobs.review).collect()
    assert made.value == 12 and len(found) == 12
    assert {r["seq"] for r in found if r["outcome"] == "refused"} == {7, 9, 11}


def test_outlines_do_not_hold_all_sides(spark):
    """A ring of one component inside another, with a hole: sides by brute force, and no aggregate of sides."""
    pixels = {(y, x): 1 if y in (0, 5) or x in (0, 5) else 2 for y in range(6) for x in range(6) if (y, x) != (2, 2)}
    labels = spark.createDataFrame([(7, y, x, c) for (y, x), c in pixels.items()], "scene_id long, y int, x int, component_id int")
    found = components.outlines(labels)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for (y, x), c in pixels.items():
        near = {("h", y, x): (y - 1, x), ("h", y + 1, x): (y + 1, x), ("v", y, x): (y, x - 1), ("v", y, x + 1): (y, x + 1)}
        want += [(7, c, *side) for side, other in near.items() if pixels.get(other) != c]
    assert sorted(map(tuple, found.select("scene_id", "component_id", "kind", "ey", "ex").collect())) == sorted(want)


def test_streams_equal_batches(spark, tmp_path):
    kinds = ("pending", "flagged", "confirmed", "rejected")
    rows = spark.createDataFrame([(k % 7, k, kinds[k * 5 % 11 % 4]) for k in range(80)], "candidate_id long, seq long, decision string")
    assert sorted(jobs.replay(spark, rows, str(tmp_path / "review"), jobs.review).collect()) == sorted(ledger.decide(rows).collect())
    events = spark.createDataFrame([(k % 3, k // 3 + 1, f"t{k}", "NOTE", "x") for k in range(30)], "ledger_id long, seq long, stamp string, action string, detail string")
    streamed = jobs.replay(spark, events, str(tmp_path / "audit"), jobs.audit)
    assert sorted(streamed.collect()) == sorted(ledger.append_chain(events).select("ledger_id", "seq", "previous_hash", "event_hash").collect())


def test_lee_filter_does_not_depend_on_the_task(spark):
    draw = np.random.default_rng(1)
    values = draw.gamma(4, 1, (20, 30))
    px = spark.createDataFrame([(1, y, x, float(values[y, x]) if (y, x) != (3, 3) else None) for y in range(20) for x in range(30)], "scene_id long, y int, x int, value double")
    v, ok = np.where(np.indices((20, 30)).sum(0) < 0, 0, values), np.ones((20, 30), bool)
    ok[3, 3] = False
    near = lambda y, x: [(min(max(y + i, 0), 19), min(max(x + j, 0), 29)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = {(y, x): [v[q] for q in near(y, x) if ok[q]] for y in range(20) for x in range(30)}
    noise = np.median([np.var(around[q]) for q in around if ok[q]])
    rows = {(r["y"], r["x"]): r["filtered"] for r in focal.lee_filter(px, 20, 30, 3).collect()}
    for q, held in around.items():
        signal = max(np.var(held) - noise, 0)
        want = np.mean(held) + signal / (signal + noise + 1e-8) * (v[q] - np.mean(held)) if ok[q] else 0
        assert rows[q] == pytest.approx(want, abs=1e-6)
    assert len(focal.lee_filter(px, 20, 30, 3, block=8).collect()) == 600
    with pytest.raises(ValueError):
        focal.lee_filter(px, 20, 30, 4)
    # A block without a valid pixel is 0, a raster without one is an error.
    half = px.withColumn("value", F.when(F.col("x") < 8, F.lit(0.0)).otherwise(F.col("value")))
    assert {r["filtered"] for r in focal.lee_filter(half, 20, 30, 3, block=4).filter("x < 8").collect()} == {0.0}
    with pytest.raises(Exception, match="no valid pixel"):
        focal.lee_filter(px.withColumn("value", F.lit(0.0)), 20, 30, 3).collect()


def test_phase_shift():
    draw = np.random.default_rng(2)
    a = draw.normal(size=(64, 64))
    dy, dx, response = focal.phase_shift(a, np.roll(a, (3, -2), (0, 1)))
    assert (dy, dx) == pytest.approx((-3, 2), abs=0.2) and response > 10
    assert np.isnan(focal.phase_shift(a, np.ones((64, 64)))[:2]).all()
    # The correlation written out as sums, on a small grid.
    a, b = draw.normal(size=(2, 6, 6))
    z = [np.clip((g - g.mean()) / g.std(), -5, 5) * np.outer(np.hanning(6), np.hanning(6)) for g in (a, b)]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(6), np.arange(6)) / 6)
    cross = (wave @ z[0] @ wave) * np.conj(wave @ z[1] @ wave)
    corr = (np.conj(wave) @ (cross / np.abs(cross)) @ np.conj(wave)).real / 36
    assert focal.phase_shift(a, b)[2] == pytest.approx(corr.max() / np.abs(corr).mean())


def test_pair_shifts_of_strips(spark):
    """Transforms that are spread over strips against those of whole grids: odd sizes, missing pixels, one row, a constant channel."""
    draw = np.random.default_rng(9)
    rows, want = [], {}
    for pair, (h, w) in enumerate(((33, 21), (8, 40), (1, 9), (17, 17))):
        for channel in ("B04", "B08"):
            a = draw.normal(100, 20, size=(h, w))
            b = np.roll(a, (2, -3), (0, 1)) + draw.normal(size=(h, w))
            if (pair, channel) == (3, "B08"):
                b[:] = 7.0
            if pair == 0:
                a[5, 5] = b[5, 5] = 0.0
            want[pair, channel] = focal.phase_shift(a, b)
            rows += [(pair, channel, y, x, float(a[y, x]), float(b[y, x])) for y in range(h) for x in range(w) if (pair, y, x) != (0, 5, 5)]
    px = spark.createDataFrame(rows, "pair_id long, channel string, y int, x int, before double, after double").repartition(5)
    for cells in (1, 50, focal.STRIP):
        got = {(r["pair_id"], r["channel"]): (r["dy"], r["dx"], r["response"]) for r in focal.pair_shifts(px, cells).collect()}
        assert got.keys() == want.keys()
        for k, values in want.items():
            assert got[k] == pytest.approx(values, abs=1e-6, nan_ok=True), k
    assert np.isnan(want[3, "B08"][0]) and not focal.pair_shifts(px.limit(0)).count()


@pytest.mark.parametrize(("least", "spread"), [(0.9, 0.08), (0.35, 1.0), (0.999999, 0.0)])
def test_clusters_of_the_metric_index(spark, least, spread):
    """Small blocks and few pivots against all pairs: groups of copies, vectors of another length, without a norm, null."""
    from skylattice.operators import retrieval

    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8))
    vecs = [list(map(float, centres[k % 12] + spread * draw.normal(size=8))) for k in range(180)]
    vecs += [vecs[0]] * 60 + [[1.0, 0.0, 0.0]] * 3 + [[0.0] * 8, None, [float("nan")] * 8]
    tiles = spark.createDataFrame([(f"T{k:04d}", v) for k, v in enumerate(vecs)], "tile_id string, vector array<double>").repartition(3)
    unit = [None if v is None or not np.linalg.norm(v) > 1e-12 else np.array(v) / np.linalg.norm(v) for v in vecs]
    near = {i: [j for j, v in enumerate(unit) if v is not None and len(v) == len(u) and round(float(np.clip(u @ v, -1, 1)), 6) >= least] for i, u in enumerate(unit) if u is not None}
    core = {i for i, n in near.items() if len(n) >= 3}
    label = {i: i for i in core}
    while True:
        new = {i: min(label[j] for j in near[i] if j in core) for i in core}
        if new == label:
            break
        label = new
    want = {f"T{i:04d}": None for i in range(len(vecs))}
    for i in near:
        at = i if i in core else min((j for j in near[i] if j in core), default=None)
        want[f"T{i:04d}"] = None if at is None else f"T{label[at]:04d}"
    got = {r["tile_id"]: r["cluster"] for r in retrieval.clusters(tiles, least, 3, pivots=5, block=16).collect()}
    assert got == want
    if least == 0.9:
        blocks, width = retrieval.metric_blocks(tiles, 5, 16)
        n = blocks.count()
        assert retrieval.near_blocks(blocks, width, float(np.arccos(least))).count() < n * (n + 1) // 2
    assert retrieval.clusters(tiles.limit(0), least, 3).count() == 0


def test_encoder_job(spark):
    from skylattice.operators import embedding

    rows = spark.createDataFrame([(k, f"http://host/{k} word{k % 3}" if k != 5 else None) for k in range(12)], "page_id long, url string")
    encode = embedding.hashed_encoder(16)
    found = {r["page_id"]: r for r in embedding.encode_rows(rows, "page_id", "url", encode, batch=4).collect()}
    for k, url in rows.collect():
        assert found[k]["error"] is None and found[k]["vector"] == pytest.approx(encode([url or ""])[0].tolist(), abs=1e-6)

    def fails(texts):
        raise ValueError("no")

    assert {(r["vector"], r["error"]) for r in embedding.encode_rows(rows, "page_id", "url", fails).collect()} == {(None, "ValueError: no")}


def test_patch_scoring(spark):
    from skylattice.operators import embedding

    px = spark.createDataFrame([(1, y, x, float(y), float(x), (y + x) % 3 > 0) for y in range(5) for x in range(7)], "scene_id long, y int, x int, before double, after double, valid boolean")
    found = embedding.score_patches(px, lambda a, b: (a + b) / 20, patch=4).collect()
    assert {(r["y"], r["x"]): r["p"] for r in found} == {(y, x): (y + x) / 20 if (y + x) % 3 else 0.0 for y in range(5) for x in range(7)}
    with pytest.raises(Exception, match="outside"):
        embedding.score_patches(px, lambda a, b: a + b + 2, patch=4).collect()


def clip_segment(a, b, box):
    """The part of a segment inside a box, or None (Liang-Barsky)."""
    (x0, y0), (x1, y1) = a, b
    t0, t1 = 0.0, 1.0
    for p, q in ((x0 - x1, x0 - box[0]), (x1 - x0, box[2] - x0), (y0 - y1, y0 - box[1]), (y1 - y0, box[3] - y0)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    if t0 > t1:
        return None
    at = lambda t: (x0, y0) if t == 0 else (x1, y1) if t == 1 else (x0 + t * (x1 - x0), y0 + t * (y1 - y0))
    return at(t0), at(t1)


def clip_line(points, box) -> list[list]:
    """Parts of a line inside a box. A part ends where the line leaves or a segment has nothing inside; a piece without
    length does not make it longer."""
    parts, going_on = [], False
    for a, b in zip(points[:-1], points[1:], strict=True):
        kept = clip_segment(a, b, box)
        if kept is None:
            going_on = False
        elif not (going_on and parts[-1][-1] == kept[0]):
            parts.append(list(kept))
            going_on = True
        elif kept[0] != kept[1]:
            parts[-1].append(kept[1])
    return parts


def clip_ring(points, box) -> list:
    """A ring cut to a box (Sutherland-Hodgman), closed; empty if nothing is left."""
    for axis, limit, up in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        inside = [p[axis] >= limit if up else p[axis] <= limit for p in points]
        out = []
        for k, b in enumerate(points):
            a = points[k - 1]
            if inside[k - 1] != inside[k]:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = limit
                out.append(tuple(cut))
            if inside[k]:
                out.append(b)
        points = out
    return [*points, points[0]] if len(points) > 2 else []


def test_clipping():
    box = (0, 0, 10, 10)
    assert clip_line([(-5, 5), (5, 5), (5, 20), (7, 5)], box) == [[(0.0, 5.0), (5.0, 5.0), (5.0, 10.0)], [(pytest.approx(6.3333, abs=1e-3), 10.0), (7.0, 5.0)]]
    assert clip_line([(20, 20), (30, 30)], box) == []
    assert clip_line([(0, 5), (10, 5), (20, 5)], box) == [[(0, 5), (10, 5)]]
    assert clip_line([(5, 5), (10, 5), (20, 5), (20, 6), (10, 6), (5, 6)], box) == [[(5, 5), (10, 5)], [(10, 6), (10, 6), (5, 6)]]
    ring = clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5)], box)
    assert ring[0] == ring[-1] and {(0, 0), (5, 0), (5, 5), (0, 5)} == set(ring)

@pytest.mark.parametrize("parts", [1, 7])
def test_clipping_of_tables(spark, parts):
    """Lines and rings as tables of points against one element at a time."""
    draw = np.random.default_rng(parts)
    box = (2.0, 3.0, 11.0, 9.0)
    shapes = {k: [tuple(map(float, p)) for p in draw.integers(0, 14, size=(int(draw.integers(1, 30)), 2))] for k in range(60)}
    shapes |= {k: [*shapes[k], shapes[k][0]] for k in range(0, 20)}
    shapes |= {100: [(5, 5), (11, 5), (20, 5), (20, 6), (11, 6), (5, 6)], 101: [(5.0, 5.0)], 102: [(0.0, 0.0), (20.0, 20.0)], 103: [(2.0, 3.0), (11.0, 3.0), (11.0, 9.0), (2.0, 9.0)], 104: [(0.1, 3.7), (7.3, 4.9), (7.3, 4.9), (10.9, 8.1)]}
    rows = [(k, c, i, float(x), float(y)) for k, pts in shapes.items() for c in (False, True) for i, (x, y) in enumerate(pts)]
    points = spark.createDataFrame([(2 * k + c, c, i, x, y) for k, c, i, x, y in rows], "id long, closed boolean, seq long, x double, y double").repartition(parts)
    want = {}
    for k, pts in shapes.items():
        pts = [tuple(map(float, p)) for p in pts]
        want[2 * k] = clip_line(pts, box)
        ring = pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts
        want[2 * k + 1] = [r for r in [clip_ring(ring, box) if len(ring) > 2 else []] if r]
    got = {}
    for r in sorted(clipping.clip_elements(points, box).collect(), key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], {}).setdefault(r["part"], []).append((r["x"], r["y"]))
    assert {k: list(v.values()) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all(list(v) == list(range(len(v))) for v in got.values())
    assert clipping.clip_elements(points.limit(0), box).count() == 0


@pytest.mark.parametrize("spread", [10**6, 9])
def test_clipping_by_sql(spark, tmp_path, spread, monkeypatch):
    """F8 with elements in one task, and with those of over nine points spread, against its SQL; values and places that are missing too. One shuffle of
    lines and one of rings while no element is long."""
    import duckdb

    from skylattice.plans import job_queries
    from skylattice.plans.registry import ORACLES

    clip = clipping.clip_elements
    monkeypatch.setattr(clipping, "clip_elements", lambda points, box: clip(points, box, spread))
    rows = [(e if e % 89 else None, None if e % 97 == 5 else u, None if e % 11 == 3 else float(e * e % 457) / 4) for e, u in ((e, e * e * 7 % 131 % (40 if e % 3 else 4)) for e in range(1500))]
    rows = [r for r in rows if r[0] is not None] + [(None, u, 30.0 + u) for u in range(8)] + [(9001, 77, 40.0), (9002, 76, 40.0)] + [(9700 + k, 78, 30.0 + 30 * (k % 2)) for k in (25, 40, 60, 122)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = job_queries.f8(spark, str(tmp_path))
    if spread > len(rows):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(f"SELECT id, part, pos, x, y FROM ({ORACLES['F8']})").fetchall()
    assert len(want) > 300 and len({r[0] for r in want}) > 20
    low = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, found.select("id", "part", "pos", "x", "y").collect()), key=low) == sorted(want, key=low)


def test_patches_mirror_beyond_the_edge(spark):
    px = grid(spark, [[10 * y + x for x in range(5)] for y in range(5)]).withColumn("truth", F.lit(1))
    grids = spark.createDataFrame([(1, 5, 5)], "scene_id long, height int, width int")
    rows = {(r["top"], r["left"], r["i"], r["j"]): r for r in training.extract(grids, px, 4, 4, "v", "truth").collect()}
    assert len(rows) == 64
    assert (rows[4, 4, 1, 1]["v"], rows[4, 4, 1, 1]["label"], rows[4, 4, 1, 1]["valid"]) == (33.0, 0, False)
    moved = training.augment(training.extract(grids, px, 4, 4, "v", "truth").filter("top = 0 AND left = 0"), 4, F.lit(3))
    assert {(r["ni"], r["nj"]): r["v"] for r in moved.collect()} == {(y, x): np.rot90(np.array([[10 * a + b for b in range(4)] for a in range(4)]))[y, x] for y in range(4) for x in range(4)}


def test_folds_are_even_and_disjoint(spark):
    rows = training.folds(spark.createDataFrame([(f"p{k}",) for k in range(14)], "id string"), "id", 5, 7).collect()
    sizes = sorted(sum(r["fold"] == f for r in rows) for f in range(5))
    assert len({r["id"] for r in rows}) == 14 and sizes == [2, 3, 3, 3, 3]


def test_sources(spark, tmp_path):
    area = {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[75.8, 22.7], [75.9, 22.7], [75.9, 22.8], [75.8, 22.7]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps(area, indent=1))
    b = aoi.load(spark, str(tmp_path / "a.geojson")).select(aoi.ring_box(F.col("rings")).alias("b")).first()["b"]
    assert tuple(b) == (75.8, 22.7, 75.9, 22.8)
    area["geometry"]["type"] = "Point"
    (tmp_path / "b.geojson").write_text(json.dumps(area))
    with pytest.raises(Exception, match="must be a Feature"):
        aoi.load(spark, str(tmp_path / "b.geojson")).collect()
    (tmp_path / "s" / "one").mkdir(parents=True)
    (tmp_path / "s" / "one" / "tiles.json").write_text(json.dumps({"source": "q", "tiles": [{"path": "t.tif", "valid_fraction": 0.9}]}))
    r = manifests.read_manifests(spark, str(tmp_path / "s")).first()
    assert r["resolved"].endswith("/s/one/t.tif") and r["valid_fraction"] == 0.9
    (tmp_path / "pairs.csv").write_bytes("﻿im_idx,pair_idx,filename,date,time,system_idx,city,city_ascii,country,lat,lng\n1,a,f.npy,20200101,70501,s,Ü,U,X,1.5,2.5\n".encode())
    r = manifests.read_pairs(spark, str(tmp_path / "pairs.csv")).first()
    assert (r["im_idx"], r["city"], r["lng"]) == ("1", "Ü", 2.5)
    np.save(tmp_path / "f.npy", np.arange(24, dtype=np.float64).reshape(2, 3, 4))
    rows = arrays.pixels(arrays.files(spark, str(tmp_path))).collect()
    assert len(rows) == 6 and {tuple(r["channels"]) for r in rows if (r["y"], r["x"]) == (1, 2)} == {(20.0, 21.0, 22.0, 23.0)}
    assert one(spark, manifests.stable_id(F.lit("a/b c/d.tif")).alias("i"))["i"] == "a__b_c__d"


def test_resampling(spark):
    px = grid(spark, [[4 * y + x for x in range(4)] for y in range(4)]).withColumnRenamed("v", "value")
    grids = spark.createDataFrame([(1,)], "scene_id long")
    same = {(r["y"], r["x"]): r["value"] for r in raster.bilinear(px, grids, 4, 4, 4, 4).collect()}
    assert same == {(y, x): 4.0 * y + x for y in range(4) for x in range(4)}
    half = {(r["y"], r["x"]): r["value"] for r in raster.average_down(px, 2, "value").collect()}
    assert half == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}
    assert math.isclose(sum(half.values()) / 4, 7.5)


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    tiles = spark.createDataFrame([(f"t{k}", "ab"[k % 2], [float(k % 5 + 1), float(k % 7), 1.0]) for k in range(30)], "tile_id string, sensor string, vector array<double>")
    queries = tiles.limit(9).selectExpr("tile_id AS query_id", "vector AS query")
    for search in (retrieval.top_k, retrieval.per_sensor):
        monkeypatch.setattr(retrieval, "MAX_QUERIES", 4096)
        want = sorted(map(tuple, search(tiles, queries, 4).select("query_id", "tile_id", "score", "rank").collect()))
        monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
        assert sorted(map(tuple, search(tiles, queries, 4).select("query_id", "tile_id", "score", "rank").collect())) == want and len(want) == 36


def test_grids_that_lack_pixels(spark):
    """A patch pixel that is missing has no value, label 0, invalid; a resampled one takes the weight of those that are there."""
    px = grid(spark, [[1.0, 2.0], [3.0, 4.0]]).filter("NOT (y = 1 AND x = 1)").withColumn("truth", F.lit(1))
    grids = spark.createDataFrame([(1, 2, 2)], "scene_id long, height int, width int")
    rows = {(r["i"], r["j"]): (r["v"], r["label"], r["valid"]) for r in training.extract(grids, px, 3, 3, "v", "truth").collect()}
    assert len(rows) == 9 and rows[1, 1] == (None, 0, False) and rows[0, 0] == (1.0, 1, True) and rows[2, 0] == (1.0, 0, False)
    one = raster.bilinear(px.select("scene_id", "y", "x", F.col("v").alias("value")), grids.select("scene_id"), 2, 2, 1, 1).collect()
    assert [r["value"] for r in one] == [pytest.approx(2.0)]
    same = raster.bilinear(px.select("scene_id", "y", "x", F.col("v").alias("value")), grids.select("scene_id"), 2, 2, 2, 2).collect()
    assert {(r["y"], r["x"]): r["value"] for r in same} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0}


def test_dates_of_files_and_of_held_texts(spark, tmp_path):
    from pyspark.errors import PySparkException

    texts = {"a": "date_1: 20150101\r\ndate_2: 20160101\r\n", "b": "t1:20170101\n\nt2: 20180101:x"}
    for name, text in texts.items():
        (tmp_path / "each" / name).mkdir(parents=True)
        (tmp_path / "each" / name / "dates.txt").write_text(text, newline="")
    held = spark.createDataFrame([(f"{n}/dates.txt", t) for n, t in texts.items()], "file string, value string")
    held.coalesce(1).write.json(str(tmp_path / "held"))
    want = {"a": ["20150101", "20160101"], "b": ["20170101", "20180101:x"]}
    for rows in (manifests.read_dates(spark, str(tmp_path / "each" / "*")), manifests.two_dates(manifests.read_texts(spark, str(tmp_path / "held")))):
        assert {r["file"].split("/")[-2]: r["dates"] for r in rows.collect()} == want
    with pytest.raises(PySparkException, match="two dates"):
        manifests.two_dates(held.withColumn("value", F.lit("date_1: 20150101"))).collect()
