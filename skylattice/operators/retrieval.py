"""Vector retrieval: exact top-k by inner product with filters, and reports on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from ..storage import stage
from .ranking import with_rank

#: Queries that are broadcast at most; more of them meet the vectors partition by partition.
MAX_QUERIES = 4096


def usable(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Adds ``usable``: right dimension and a finite unit norm."""
    n = vectors.norm(F.col(vector))
    return rows.withColumn("usable", F.coalesce((F.size(vector) == dimension) & n.between(1 - 1e-5, 1 + 1e-5), F.lit(False)))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``hits`` for each query with their ``rank``, ties by tile_id; kept in each partition first."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tile_id")))
    return ranked.filter(F.col("rank") <= k)


def ranked(hits: DataFrame) -> DataFrame:
    """All ``hits`` with their ``rank`` for each query, ties by tile_id. Range partitions are sorted and numbered each by itself, and one row for each
    query in each partition gives the start, so a query with any number of hits is no single task; a hit is shuffled once and stored once."""
    order = ["query_id", F.desc("score"), "tile_id"]
    rows = stage(hits.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    firsts = rows.groupBy("_part", "query_id").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(firsts.select("_part", "query_id", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")), "starts")
    few = starts.limit(MAX_STARTS + 1).count() <= MAX_STARTS
    placed = rows.join(F.broadcast(starts) if few else starts, ["_part", "query_id"])
    return placed.select(*hits.columns, (F.col("_id") + F.col("_shift")).cast("int").alias("rank"))


#: Starts of ranks that are broadcast at most, one for each query in each partition.
MAX_STARTS = 200_000
#: Vectors in a block.
BLOCK = 1024


def _best_of(asked: np.ndarray, tiles: np.ndarray, groups: np.ndarray, k: int | None, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the tile, score) of the hits that can be among the best ``k`` of a query in a group: those no worse than its
    k-th among these tiles, and those of a score of ``limit`` or more; ties and rounding included."""
    score = np.clip(asked @ tiles.T, -1.0, 1.0)
    least = np.full(score.shape, -2.0 if limit is None else limit)
    if k is not None:
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            if len(at) > k:
                own = np.partition(score[:, at], -k, axis=1)[:, -k]
                least[:, at] = np.maximum(least[:, at], own[:, None])
    r, c = np.nonzero(score >= least - 2e-6)
    return r, c, score[r, c]


def _chunked_hits(asked: list[tuple[pa.Array, np.ndarray]], tiles: pa.RecordBatch | pa.Table, k: int | None, limit: float | None) -> Iterator[pa.RecordBatch]:
    """Hits of all query blocks ``asked`` among ``tiles`` (unit, tile_id, part), a block of either at a time."""
    tiles = tiles.combine_chunks() if isinstance(tiles, pa.Table) else tiles
    unit, tile_id, part = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (tiles.column(n) for n in ("unit", "tile_id", "part")))
    sizes = pc.list_value_length(unit).to_numpy(zero_copy_only=False)
    groups = pc.rank(pc.fill_null(part, ""), tiebreaker="dense").to_numpy()
    for ids, matrix in asked:
        places = np.flatnonzero(sizes == matrix.shape[1])
        for a in range(0, len(places), BLOCK):
            at = places[a : a + BLOCK]
            own = pc.list_flatten(unit.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
            r, c, score = _best_of(matrix, own, groups[at], k, limit)
            near = pa.array(at[c])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), tile_id.take(near), part.take(near), pa.array(score)], ["query_id", "tile_id", "part", "score"])


def _query_blocks(asked: pa.Table) -> list[tuple[pa.Array, np.ndarray]]:
    """(query_ids, matrix) of queries of one length, ``BLOCK`` at most."""
    ids, unit = (asked.column(c).combine_chunks() for c in ("query_id", "unit"))
    sizes = pc.list_value_length(unit).to_numpy(zero_copy_only=False)
    blocks = []
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        for a in range(0, len(places), BLOCK):
            at = pa.array(places[a : a + BLOCK])
            blocks.append((ids.take(at), pc.list_flatten(unit.take(at)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d))))
    return blocks


#: Vectors of a cell, where too many queries to be broadcast meet the tiles.
CELL = 32 * BLOCK


def block_hits(tiles: DataFrame, queries: DataFrame, k: int | None = None, within: str | None = None, least: float | None = None) -> DataFrame:
    """(query_id, tile_id, part, score): hits among which are the best ``k`` of each query, in each value of ``within`` if given, or all of a
    score of ``least`` or more.

    Vectors meet as matrices, a block of tiles and a block of queries at a time, of whose products only what can be among the best goes on, so a
    task holds one batch of tiles. A query set of no more than MAX_QUERIES is broadcast; of a larger one, cells of tiles and cells of queries
    meet by shuffles. Vectors of another length than the query's, and those without a norm, score nothing.
    """
    held = tiles.select("tile_id", (F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))).alias("part"), vectors.unit(F.col("vector")).alias("unit")).filter("unit IS NOT NULL")
    asked = queries.select("query_id", vectors.unit(F.col("query")).alias("unit")).filter("unit IS NOT NULL")
    schema = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c, x in (("query_id", asked), ("tile_id", held), ("part", held))) + ", score double"
    first = asked.limit(MAX_QUERIES + 1).toArrow()
    if first.num_rows <= MAX_QUERIES:
        sent = tiles.sparkSession.sparkContext.broadcast(_query_blocks(first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _chunked_hits(sent.value, batch, k, least)

        hits = held.mapInArrow(run, schema)
    else:
        n, m = (-(-x.count() // size) for x, size in ((asked, MAX_QUERIES), (held, CELL)))
        cells = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
        all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = held.withColumn("_cell", cells("tile_id", max(m, 1))).withColumn("_query_cell", all_of(n))
        right = asked.withColumn("_query_cell", cells("query_id", n)).withColumn("_cell", all_of(max(m, 1)))

        def meet(tiles: pa.Table, asked: pa.Table) -> pa.Table:
            found = list(_chunked_hits(_query_blocks(asked), tiles, k, least)) if tiles.num_rows and asked.num_rows else []
            return pa.Table.from_batches(found) if found else empty

        kinds = [to_arrow_type(held.schema["tile_id"].dataType), to_arrow_type(held.schema["part"].dataType)]
        empty = pa.table({"query_id": pa.array([], to_arrow_type(asked.schema["query_id"].dataType)), "tile_id": pa.array([], kinds[0]), "part": pa.array([], kinds[1]), "score": pa.array([], pa.float64())})
        keys = ("_cell", "_query_cell")
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    hits = hits.withColumn("score", F.round("score", 6))
    return hits if least is None else hits.filter(F.col("score") >= least)


def _hydrated(hits: DataFrame, tiles: DataFrame) -> DataFrame:
    """``hits`` with the columns of their tiles but for the vector."""
    return tiles.drop("vector").join(hits, "tile_id")


def top_k(tiles: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The columns of ``tiles``, query_id, score and rank of the k best tiles of each query; tile_id names a tile."""
    return _hydrated(best(block_hits(tiles, queries, k).drop("part"), k), tiles)


def like_seeds(tiles: DataFrame, seeds: DataFrame, k: int, within: str, own: str) -> DataFrame:
    """(query_id, tile_id, score, within, rank): the best ``k`` tiles for each seed (query_id, query, ``own``, ``within``) among those of the seed's
    value of ``within``, its own tile ``own`` left out. A seed without that value finds nothing."""
    hits = block_hits(tiles, seeds, k + 1, within)
    asked = seeds.select("query_id", F.col(own).alias("_own"), within)
    return best(hits.join(asked, "query_id").filter((F.col("part") == F.col(within).cast("string")) & (F.col("tile_id") != F.col("_own"))).drop("part", "_own"), k)


def per_sensor(tiles: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each sensor, merged to the best k of each query."""
    inner = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "tile_id")
    hits = block_hits(tiles, queries, k, "sensor").withColumn("i", F.row_number().over(inner)).filter(F.col("i") <= k).drop("i", "part")
    return _hydrated(best(hits, k), tiles)


def diagnostics(hits: DataFrame, eligible: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """Scores of each query's hits, and how many rows passed the filter in the catalogue and in the index."""
    s = F.col("score")
    found = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"), F.round(F.avg(s), 6).alias("mean"))
    for rows, name in ((eligible, "eligible"), (indexed, "indexed_eligible")):
        if rows is not None:
            found = found.join(rows.agg(F.count("*").alias(name)))
    return found


def vector_checks(batch: DataFrame, index: DataFrame, dimension: int) -> DataFrame:
    """(tile_id, reason): the first rule that a vector to be added breaks, null if none."""
    n = vectors.norm(F.col("vector"))
    twice = F.count("*").over(Window.partitionBy("tile_id")) > 1
    known = index.select(F.col("tile_id").alias("known")).distinct()
    reason = (
        F.when(F.coalesce("tile_id", F.lit("")) == "", "empty_id").when(F.col("twice"), "duplicate_in_batch").when(F.col("known").isNotNull(), "already_indexed")
        .when(F.size("vector") != dimension, "dimension").when(F.isnan(n) | (n == float("inf")), "not_finite").when(n <= 1e-12, "zero")
    )
    return batch.withColumn("twice", twice).join(known, F.col("tile_id") == F.col("known"), "left").select("tile_id", reason.alias("reason"))


def similar_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner products of the unit vectors of two tables joined on ``pair``."""
    one = a.select("pair", F.col("tile_id").alias("tile_1"), vectors.unit(F.col("vector")).alias("u"))
    two = b.select("pair", F.col("tile_id").alias("tile_2"), vectors.unit(F.col("vector")).alias("v"))
    return one.join(two, "pair").select("pair", "tile_1", "tile_2", F.round(vectors.cosine(F.col("u"), F.col("v")), 6).alias("similarity"))


#: Pivots of a metric index at most.
PIVOTS = 64


def spread_pivots(units: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for each length of vector: of the 8 * ``most`` vectors with the smallest hashes of tile_id, those that lie farthest from the
    ones taken before, ``most`` in all lengths together. Any choice gives right results; a good one skips more."""
    drawn = units.orderBy(F.xxhash64("tile_id"), "tile_id").limit(8 * most).select("unit").collect()
    found: dict[int, list[np.ndarray]] = {}
    for row in drawn:
        found.setdefault(len(row["unit"]), []).append(np.array(row["unit"], float))
    pivots = {}
    for d, vecs in found.items():
        v = np.array(vecs)
        taken, nearest = [0], v @ v[0]
        while len(taken) < max(1, most * len(v) // len(drawn)) and nearest.min() < 1 - 1e-9:
            taken.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, v @ v[taken[-1]])
        pivots[d] = v[taken]
    return pivots


#: Vectors that all others meet before blocks do, where clusters are sought.
HUB = 4096
#: Groups of settled cores that have blocks of their own, the largest ones.
PARTS = 8


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which vectors of two matrices have a similarity of ``least`` or more, in six digits; only scores that rounding can decide are rounded."""
    score = a @ b.T
    low, high = (np.floor(least * 1e6) - 1) / 1e6, (np.ceil(least * 1e6) + 1) / 1e6
    near = score > high
    doubtful = np.nonzero((score >= low) & ~near)
    near[doubtful] = np.round(np.clip(score[doubtful], -1, 1), 6) >= least
    return near


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least node of the group of each node, after nodes ``a`` and ``b`` are linked one by one."""
    while True:
        one, two = label[a], label[b]
        if (one == two).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]


def _near_parts(v: np.ndarray, ids: pa.Array, hub: tuple[pa.Array, np.ndarray, np.ndarray], least: float, min_points: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, part), each once: the parts of the hub, which is in their order, that vectors are next to, of those with ``min_points`` neighbours
    in the hub alone, themselves included."""
    names, matrix, part = hub
    near = _similar(v, matrix, least)
    own = np.round(np.clip((v * v).sum(1), -1, 1), 6) >= least
    n = near.sum(1) + (own & ~pc.is_in(ids, value_set=names).to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.diff(part, prepend=-2))
    place, at = np.nonzero(np.logical_or.reduceat(near, starts, axis=1) & (part[starts] >= 0) & (n >= min_points)[:, None])
    return place, part[starts[at]]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) of rows with vectors of one length, ``BLOCK`` at most."""
    sizes = pc.list_value_length(batch.column("unit")).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        for a in range(0, len(places), BLOCK):
            part = batch.take(pa.array(places[a : a + BLOCK]))
            yield int(d), part, pc.list_flatten(part.column("unit")).to_numpy(zero_copy_only=False).reshape(-1, d)


def _count_parts(hub, least: float, min_points: int):
    """(part, other, n): how many vectors are next to a part, and to which others as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for d, rows, v in _by_length(batch):
                if d not in hub.value:
                    continue
                place, part = _near_parts(v, rows.column("tile_id"), hub.value[d], least, min_points)
                first = np.full(len(v), np.iinfo(np.int64).max)
                np.minimum.at(first, place, part)
                for (a, b), n in zip(*(x.tolist() for x in np.unique(np.stack([first[place], part], 1), axis=0, return_counts=True)), strict=True):
                    found[a, b] = found.get((a, b), 0) + n
        keys = np.array(list(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.array(list(found.values()), np.int64))], ["part", "other", "n"])

    return run


def hub_parts(units: DataFrame, least: float, min_points: int, block: int = BLOCK):
    """A function (d, ids, matrix) to the part of each vector: vectors of one part are cores for certain and hang together, -1 knows nothing.

    The hub, the ``HUB`` vectors with the smallest hashes of tile_id, is grouped by itself. A vector with ``min_points`` neighbours in it is a
    core whatever else it is next to, and hangs together with the cores of the hub next to it. Only the ``PARTS`` largest parts count, of
    ``block`` vectors or more. In a dense table nearly all vectors are of one part; where the hub is too thin, none is."""
    drawn = units.orderBy(F.xxhash64("tile_id"), "tile_id").limit(HUB).select(F.col("tile_id").alias("query_id"), "unit").toArrow()
    held: dict[int, list] = {}
    for ids, matrix in _query_blocks(drawn):
        held.setdefault(matrix.shape[1], []).append((ids, matrix))

    def in_order(ids: pa.Array, matrix: np.ndarray, part: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        order = np.argsort(part, kind="stable")
        return ids.take(pa.array(order)), matrix[order], part[order]

    hub, total = {}, 0
    for d, blocks in held.items():
        matrix = np.concatenate([m for _, m in blocks])
        core = np.concatenate([_similar(m, matrix, least).sum(1) for _, m in blocks]) >= min_points
        label, start = np.arange(len(matrix)), 0
        for _, m in blocks:
            r, c = np.nonzero(_similar(m, matrix, least) & core & core[start : start + len(m), None])
            label, start = _united(label, r + start, c), start + len(m)
        hub[d] = in_order(pa.concat_arrays([i for i, _ in blocks]), matrix, np.where(core, label + total, -1))
        total += len(matrix)

    context = units.sparkSession.sparkContext
    met = units.mapInArrow(_count_parts(context.broadcast(hub), least, min_points), "part long, other long, n long").groupBy("part", "other").agg(F.sum("n").alias("n"))
    met = stage(met, "parts")
    large = [r["part"] for r in met.filter((F.col("part") == F.col("other")) & (F.col("n") >= block)).orderBy(F.desc("n"), "part").limit(PARTS).collect()]
    kept = np.full(total + 1, -1)
    for part in large:
        kept[part] = part
    for r in met.filter(F.col("part").isin(large) & F.col("other").isin(large)).collect():
        one, two = sorted((kept[r["part"]], kept[r["other"]]))
        kept[kept == two] = one
    sent = context.broadcast({d: in_order(ids, matrix, kept[part]) for d, (ids, matrix, part) in hub.items()})

    def part_of(d: int, ids: pa.Array, v: np.ndarray) -> np.ndarray:
        found = np.full(len(v), total)
        if d in sent.value:
            np.minimum.at(found, *_near_parts(v, ids, sent.value[d], least, min_points))
        return np.where(found == total, -1, found)

    return part_of


def _angles(pivots: dict[int, np.ndarray], width: int, part_of: Callable | None):
    """Adds to (tile_id, unit) its length, its part (-1 without ``part_of``), the nearest pivot of that length and the angles to all of them, padded with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, v in _by_length(batch):
                angle = np.zeros((len(v), width))
                region = np.zeros(len(v), np.int32)
                if d in pivots:
                    own = np.arccos(np.clip(v @ pivots[d].T, -1, 1))
                    angle[:, : own.shape[1]], region = own, own.argmin(1).astype(np.int32)
                part = np.full(len(v), -1) if part_of is None else part_of(d, rows.column("tile_id"), v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(angle.ravel()))
                near = angle[np.arange(len(v)), region]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("tile_id"), rows.column("unit"), pa.array(np.full(len(v), d, np.int32)), pa.array(part.astype(np.int32)), pa.array(region), pa.array(near), lists],
                    ["tile_id", "unit", "d", "part", "region", "near", "angles"],
                )

    return run


def _pack_regions(size: int, width: int):
    """Blocks of rows that follow each other in one region and part, with the least and the largest angle to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, part_no, region = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "part", "region"))
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(part_no) != 0) | (np.diff(region) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for i in range(a, b, size):
                    part = batch.slice(i, min(size, b - i))
                    unit = pc.list_flatten(part.column("unit")).to_numpy(zero_copy_only=False)
                    angle = pc.list_flatten(part.column("angles")).to_numpy(zero_copy_only=False).reshape(-1, width)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("tile_id"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d[i])], pa.int32()), pa.array([int(part_no[i])], pa.int32()), pa.array([int(region[i])], pa.int32()), pa.array([angle.min(0).tolist()], pa.list_(pa.float64())), pa.array([angle.max(0).tolist()], pa.list_(pa.float64())), pa.array([unit.tobytes()]), ids],
                        ["d", "part", "region", "low", "high", "matrix", "ids"],
                    )

    return run


def _apart(width: int, reach: float):
    """Whether two blocks (low, high; low_2, high_2) are farther from each other than ``reach`` as seen from some pivot."""
    gap = F.greatest(*(F.greatest(F.col("low")[k] - F.col("high_2")[k], F.col("low_2")[k] - F.col("high")[k]) for k in range(width))) if width > 1 else F.greatest(F.col("low")[0] - F.col("high_2")[0], F.col("low_2")[0] - F.col("high")[0])
    return gap > reach


def metric_blocks(tiles: DataFrame, pivots: int = PIVOTS, block: int = BLOCK, parts: Callable[[DataFrame], Callable] | None = None) -> tuple[DataFrame, int]:
    """(blocks, width): a metric index of unit vectors on the sphere. Vectors are dealt to the region of their nearest pivot, sorted by the angle to
    it and cut into blocks of at most ``block``, each with the range of its angles to all pivots. By the triangle inequality two
    blocks whose ranges are farther apart than an angle at some pivot hold no pair within that angle. A region may hold any share
    of the rows: its blocks are spread over range partitions. Vectors without a norm are left out. ``parts`` makes of the unit vectors a function
    like that of ``hub_parts``; a block is of one part."""
    units = stage(tiles.select("tile_id", vectors.unit(F.col("vector")).alias("unit")).filter("unit IS NOT NULL"), "units")
    chosen = spread_pivots(units, pivots)
    width = max((len(v) for v in chosen.values()), default=1)
    kind = units.schema["tile_id"].dataType.simpleString()
    part_of = None if parts is None else parts(units)
    placed = units.mapInArrow(_angles(chosen, width, part_of), f"tile_id {kind}, unit array<double>, d int, part int, region int, near double, angles array<double>")
    order = ["d", "part", "region", "near", "tile_id"]
    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = sorted_rows.mapInArrow(_pack_regions(block, width), f"d int, part int, region int, low array<double>, high array<double>, matrix binary, ids array<{kind}>")
    return stage(packed.withColumn("block", F.monotonically_increasing_id()), "blocks"), width


def near_blocks(blocks: DataFrame, width: int, reach: float) -> DataFrame:
    """(block, block_2), each pair once and each block with itself: pairs that can hold vectors within the angle ``reach``, but for those of one
    settled part, which have nothing to say. Regions meet first, at most the square of the number of pivots and parts, then the blocks of
    the regions that are left, by their ranges alone."""
    lows, highs = (F.array(*(f(F.col(c)[k]) for k in range(width))).alias(c) for c, f in (("low", F.min), ("high", F.max)))
    regions = blocks.groupBy("d", "part", "region").agg(lows, highs)
    other = regions.select("d", *(F.col(c).alias(f"{c}_2") for c in ("part", "region", "low", "high")))
    here, there = F.struct("part", "region"), F.struct("part_2", "region_2")
    open_ones = (F.col("part") < 0) | (F.col("part") != F.col("part_2"))
    meet = regions.join(other, "d").filter(open_ones & (here <= there)).filter(~_apart(width, reach)).select("d", "part", "region", "part_2", "region_2")
    held = blocks.select("d", "part", "region", "block", "low", "high")
    second = held.select("d", *(F.col(c).alias(f"{c}_2") for c in ("part", "region", "block", "low", "high")))
    pairs = held.join(meet, ["d", "part", "region"]).join(second, ["d", "part_2", "region_2"])
    once = (here < there) | (F.col("block") <= F.col("block_2"))
    return pairs.filter(once).filter(~_apart(width, reach)).select("block", "block_2")


def _matrices(batch: pa.RecordBatch, i: int, least: float):
    """(ids, ids_2, near) of a pair of blocks: which vectors have a similarity of ``least`` or more, in six digits."""
    d = batch.column("d")[i].as_py()
    a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(-1, d) for c in ("matrix", "matrix_2"))
    return batch.column("ids")[i].values, batch.column("ids_2")[i].values, _similar(a, b, least)


def _count_near(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ids_2, near = _matrices(batch, i, least)
                sides = [(ids, near.sum(1))] if batch.column("block")[i] == batch.column("block_2")[i] else [(ids, near.sum(1)), (ids_2, near.sum(0))]
                for names, n in sides:
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(n[at].astype(np.int64))], ["tile_id", "n"])

    return run


def _link_cores(least: float):
    """Links of a pair of blocks: each core to the least core that it reaches inside the pair (kind 0), which keeps what hangs together with one
    row for each core, and each other tile to the least core next to it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ids_2, near = _matrices(batch, i, least)
                names = pa.concat_arrays([ids, ids_2])
                core, core_2 = (np.array(batch.column(c)[i].as_py(), bool) for c in ("core", "core_2"))
                node = pc.rank(names, tiebreaker="dense").to_numpy().astype(np.int64) - 1
                n = node.max() + 1
                by_node, is_core = np.empty(n, np.int64), np.zeros(n, bool)
                by_node[node], is_core[node] = np.arange(len(node)), np.concatenate([core, core_2])
                r, c = np.nonzero(near)
                a, b, from_core, to_core = node[r], node[len(ids) + c], core[r], core_2[c]
                both = from_core & to_core
                border = np.full(n, n)
                np.minimum.at(border, a[to_core], b[to_core])
                np.minimum.at(border, b[from_core], a[from_core])
                label = np.where(is_core, _united(np.arange(n), a[both], b[both]), border)
                at = np.flatnonzero((label < n) & ~(is_core & (label == np.arange(n))))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(by_node[at])), names.take(pa.array(by_node[label[at]])), pa.array((~is_core[at]).astype(np.int32))], ["tile_id", "near_id", "kind"])

    return run


#: Blocks of a chunk at most; two chunks meet in a task.
CHUNK = 32
#: Results of pairs of blocks that are held before equal rows become one.
HELD = 32


def _met(pairs: DataFrame, blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What ``run`` says of each of the ``pairs`` (block, block_2) of ``blocks``; a column n is summed over equal rows of a task, other equal rows are one.

    Blocks are dealt to chunks and a matrix is sent once for each pair of chunks, not for each pair of blocks, so that what is shuffled is
    less by the size of a chunk; a task holds two chunks."""
    size = min(chunk, max(1, -(-blocks.count() // 8)))
    place = stage(with_rank(blocks.select("block"), ["block"], "_place").select("block", F.floor((F.col("_place") - 1) / size).alias("chunk")), "chunks")
    known = pairs.join(place, "block").join(place.select(F.col("block").alias("block_2"), F.col("chunk").alias("chunk_2")), "block_2")
    cells = stage(known.select(F.least("chunk", "chunk_2").alias("_low"), F.greatest("chunk", "chunk_2").alias("_high"), "block", "block_2"), "cells")
    sent = cells.select(F.col("_low").alias("_a"), F.col("_high").alias("_b")).distinct().withColumn("chunk", F.explode(F.array_distinct(F.array("_a", "_b"))))
    columns = [c for c in ("block", "d", "matrix", "ids", "core") if c in blocks.columns]
    held = blocks.select(*columns).join(place, "block").join(sent, "chunk").select("_a", "_b", *columns)
    sides = [columns, ["block_2", "d_2", *(f"{c}_2" for c in columns[2:])]]

    def folded(found: list[pa.RecordBatch | pa.Table]) -> pa.Table:
        rows = pa.concat_tables([pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in found])
        if "n" in rows.column_names:
            return rows.group_by("tile_id").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["tile_id", "n"])
        return rows.group_by(rows.column_names).aggregate([])

    def meet(held: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = {b: held.slice(i, 1).select(columns).combine_chunks() for i, b in enumerate(held.column("block").to_pylist())}
        found: list = []
        for a, b in zip(wanted.column("block").to_pylist(), wanted.column("block_2").to_pylist(), strict=True):
            both = [x for k in (a, b) for x in rows[k].to_batches()[0].columns]
            found += run(iter([pa.RecordBatch.from_arrays(both, [*sides[0], *sides[1]])]))
            if len(found) > HELD:
                found = [folded(found)]
        return folded(found)

    return held.groupBy("_a", "_b").cogroup(cells.groupBy("_low", "_high")).applyInArrow(meet, schema)


def clusters(tiles: DataFrame, least: float, min_points: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Density clusters by one radius: tiles with ``min_points`` neighbours (themselves included) of similarity
    ``least`` or more are cores, cores that are neighbours share a cluster, a border tile goes to the
    smallest core next to it, others are noise (null). tile_id names a tile.

    Neighbours are found by ``metric_blocks``: pairs of blocks that no pivot tells apart meet as matrices, exactly. Neighbours are
    counted, not listed, and cores are linked by one row for each core and pair of blocks, so a dense group costs no more rows than a
    sparse one. Pairs of cores that are known to hang together (``hub_parts``) are not looked at, so in a dense table nearly all vectors meet the
    hub alone. How many pairs of blocks are skipped depends on the data: none if ``least`` is a wide angle and the hub settles nothing."""
    from .graph import least_reachable

    reach = float(np.arccos(np.clip(least - 1e-6, -1, 1))) + 1e-6
    blocks, width = metric_blocks(tiles, pivots, block, lambda units: hub_parts(units, least, min_points, block))
    settled = blocks.filter("part >= 0").select("part", F.explode("ids").alias("tile_id"))
    pairs = stage(near_blocks(blocks, width, reach), "near-blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    counts = _met(pairs, blocks, _count_near(least), f"tile_id {kind}, n long").groupBy("tile_id").agg(F.sum("n").alias("n"))
    core = stage(counts.filter(F.col("n") >= min_points).select("tile_id").union(settled.select("tile_id")).distinct(), "cores")
    members = blocks.select("block", F.posexplode("ids").alias("at", "tile_id")).join(core.withColumn("is_core", F.lit(True)), "tile_id", "left")
    flags = members.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("is_core", F.lit(False)).alias("c")))).alias("f"))
    flagged = blocks.join(flags.select("block", F.transform("f", lambda x: x["c"]).alias("core")), "block")
    known = settled.join(F.broadcast(settled.groupBy("part").agg(F.min("tile_id").alias("near_id"))), "part").select("tile_id", "near_id", F.lit(0).alias("kind"))
    links = stage(_met(pairs, flagged, _link_cores(least), f"tile_id {kind}, near_id {kind}, kind int").union(known), "links")
    labels = least_reachable(links.filter("kind = 0"), "tile_id", "near_id")
    at = core.select("tile_id", F.col("tile_id").alias("at")).union(links.filter("kind = 1").groupBy("tile_id").agg(F.min("near_id").alias("at")))
    named = at.join(labels.withColumnRenamed("node", "at"), "at", "left").select("tile_id", F.coalesce("label", "at").alias("cluster"))
    return tiles.select("tile_id").join(named, "tile_id", "left")
