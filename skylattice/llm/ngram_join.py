"""N-gram Jaccard join in the Jaccard metric space: pivots, Voronoi regions, recursion, exact links.

A document is the set of its distinct 3-word shingles; d(x, y) = 1 - |x & y| / |x | y| is a metric.
Two documents link when d <= 1 - 0.9. Callers may ask for another width and another share; the figures
below are those of 3 words and 0.9.

First level. The pivots are the one-shingle sets {s}. A document's nearest pivots are the shingles
that it holds (all at distance 1 - 1/n), and ties go to the rarer, then to the smaller code, so that
each document falls into the region of its first shingle in that order. The plain triangle window is
empty of meaning at such distances, so the boundary window is counted instead: two linked documents
share at least 0.9 n shingles of either, hence their first common shingle is among the first
n - ceil(0.9 n) + 1 of both. Each document is replicated to those regions and to no other. Inside a
region two more windows hold, both from Lipschitz maps of the set: sizes differ by at most a tenth
(distance to the empty set), and so do 256 counts of shingles by code class, in sum (distance to the
256 class pivots).

Second level. What is left of a region are groups of really similar documents. They join recursively
around real pivots: the document nearest to the group's common shingles is the pivot, documents within
0.1 link to it, the triangle inequality |d(x,p) - d(y,p)| <= 0.1 bounds who else may link, and the
documents that the pivot does not reach are split by that window and joined in the same way. Links
that lie between two documents already linked to one pivot need no test: they cannot change a
component.

A group that is too large for a task is divided on Spark, round by round, in the same way. Sampled members and one made-up
set, the shingles that half of the sample holds, are the group's pivots; each member goes to the Voronoi region of its nearest
pivot and, as a boundary copy, to every region whose pivot is at most 0.2 farther. Members within 0.1 of a pivot are linked to
it, and members within 0.05 of the made-up centre are linked to each other by the triangle inequality; a region in which all
are linked is done, and in others only the linked ones in the window of a member that is not go on. A region with few members
that must meet all others is cut into slices of the others, each with those few. What is still too large is divided again; where
a round does not halve a group, pairs of blocks of it meet instead.

The order of shingles is by how many sets hold them, rare ones first. Texts are packed into chunks; a chunk asks buckets in how
many sets of all chunks its shingles are, and leaves out those that no other set holds: no other set can meet it there.
Equal sets are one set throughout.

Defined cases: a null, empty or blank text has the empty set and links with nothing; one or two words
are one shingle; repeated rows are equal sets; a null doc_id gets the component of its set, and links sets like any other; other
columns are not read. Shingles are 64-bit codes of the words.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, bucket_of, few, mix, packed, slices, spans_of, stage, table, unpacked
from .components import components
from .substring_dedup import CHUNK, CHUNK_BYTES, chunks_of, texts_of

SHINGLE = 3
PERCENT = 90
#: Shingles of a bucket, about, once there are more than ``LEAST_BUCKETS`` full ones.
BUCKET = 2_000_000
LEAST_BUCKETS = 64
#: Shingles of a bucket that are counted at once.
AT_ONCE = 250_000
CLASSES = 256
#: Members of a group that one task joins; larger groups are dealt out.
MAX_REGION = 20_000
#: Members of a first-level region up to which one task tests pairs by their class counts; a larger region is a group
#: as it is, and is dealt out.
MAX_TESTED = 30_000


# ----------------------------------------------------------------------------------- shingle sets


class Sets:
    """Shingle sets of a slice of texts: ``codes`` sorted and distinct inside each row, ``row`` the
    row of each code, ``n`` the sizes and ``sig`` a 64-bit signature of each row's set."""

    def __init__(self, column: pa.Array, width: int = SHINGLE) -> None:
        words = Words(column, lower=True)
        at, codes = words.grams(width)
        rows = words.row[at]
        n_words = np.bincount(words.row, minlength=words.n_rows)
        first = np.cumsum(n_words) - n_words
        for k in range(1, width):  # a text of fewer words is one shingle
            short = np.flatnonzero(n_words == k)
            code = np.full(len(short), np.uint64(k))
            for j in range(k):
                code += mix(words.code[first[short] + j] + np.uint64(j))
            rows, codes = np.concatenate([rows, short]), np.concatenate([codes, mix(code)])
        order = np.lexsort((codes, rows))
        rows, codes = rows[order], codes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
        self.row, self.codes = rows[new], codes[new]
        self.n = np.bincount(self.row, minlength=words.n_rows)
        self.first = np.cumsum(self.n) - self.n
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(mix(self.codes), out=sums[1:])
        self.sig = mix(sums[self.first + self.n] - sums[self.first] + self.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _with_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for part in slices(batches, "text"):
        yield part, Sets(part.column("text"), width)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _with_sets(batches, width):
            kinds = np.bincount(sets.row * CLASSES + (sets.codes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=len(sets.n) * CLASSES)
            kinds = np.minimum(kinds, 255).astype(np.uint8).reshape(-1, CLASSES)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sets.n), _signed(sets.sig), pa.array([x.tobytes() for x in kinds], pa.binary())],
                ["doc_id", "n", "sig", "classes"],
            )

    return run


def _held_keys(sets: Sets, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper ``bits`` of the codes of a chunk's different sets, and in how many of these sets each is."""
    once = np.zeros(len(sets.n), bool)
    once[np.unique(sets.sig, return_index=True)[1]] = True
    return np.unique(sets.codes[once[sets.row]] >> np.uint64(64 - bits), return_counts=True)


def _asked(width: int, bits: int, buckets: int):
    """What a chunk holds, to buckets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in batches:
            for k in range(batch.num_rows):
                keys, count = _held_keys(Sets(texts_of(batch, k)[1], width), bits)
                bucket = bucket_of(keys << np.uint64(64 - bits), buckets)
                spans = spans_of(bucket)
                columns = [
                    pa.array([bucket[a] for a, _ in spans], pa.int64()), pa.array([batch.column("chunk")[k].as_py()] * len(spans), pa.int64()),
                    pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()), pa.array([packed(count[a:b]) for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "counts"])
        pa.default_memory_pool().release_unused()

    return run


def _counted(t: pa.Table) -> pa.Table:
    """One bucket: to each chunk the counts over all chunks of what it holds, 255 at most. Keys are evenly spread, so equal
    ranges of them, of about ``AT_ONCE`` entries, are counted one after the other."""
    held = [np.cumsum(unpacked(x.as_py()).view(np.uint64)) for x in t.column("keys")]
    counts = [np.minimum(unpacked(x.as_py()), 255).astype(np.uint8) for x in t.column("counts")]
    low, high = min(int(x[0]) for x in held), max(int(x[-1]) for x in held)
    n_ranges = sum(map(len, held)) // AT_ONCE + 1
    edges = np.array([low + (high - low) * k // n_ranges for k in range(1, n_ranges)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(x, edges), len(x)] for x in held])
    for k in range(n_ranges):
        spans = cuts[:, k : k + 2].tolist()
        known, at = np.unique(np.concatenate([x[i:j] for x, (i, j) in zip(held, spans, strict=True)]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([x[i:j] for x, (i, j) in zip(counts, spans, strict=True)]), len(known))
        answer, begin = np.minimum(sums, 255).astype(np.uint8)[at], 0
        for x, (i, j) in zip(counts, spans, strict=True):
            x[i:j] = answer[begin : begin + j - i]
            begin += j - i
    answers = pa.array([packed(x.astype(np.int64)) for x in counts], pa.binary())
    return pa.Table.from_arrays([t.column("chunk"), t.column("bucket"), answers], ["chunk", "bucket", "counts"])


def _prefixes(percent: int, width: int, bits: int):
    """(code, sig, n) of the first shingles of each set, rare ones first, that other sets hold too."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out = [pa.table({"code": pa.array([], pa.int64()), "sig": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})]
        counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in answers.sort_by("bucket").column("counts").to_pylist())])
        for k in range(chunk.num_rows):
            sets = Sets(texts_of(chunk, k)[1], width)
            weight = counts[np.searchsorted(_held_keys(sets, bits)[0], sets.codes >> np.uint64(64 - bits))]
            order = np.lexsort((sets.codes, weight, sets.row))
            place = np.arange(len(order)) - sets.first[sets.row]
            n = sets.n[sets.row]
            take = (place < n - (percent * n + 99) // 100 + 1) & (weight[order] > 1)
            once = np.zeros(len(sets.n), bool)
            once[np.unique(sets.sig, return_index=True)[1]] = True
            take &= once[sets.row]
            out.append(pa.Table.from_arrays([_signed(sets.codes[order][take]), _signed(sets.sig[sets.row][take]), pa.array(n[take].astype(np.int32))], ["code", "sig", "n"]))
        return pa.concat_tables(out)

    return run


def _payload(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _with_sets(batches, width):
            parts = [sets.codes[a : a + k].tobytes() for a, k in zip(sets.first, sets.n, strict=True)]
            yield pa.RecordBatch.from_arrays([_signed(sets.sig), pa.array(parts, pa.binary())], ["sig", "codes"])

    return run


# --------------------------------------------------------------------------------- groups in tasks


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most_rows and len(held) < 50:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(whole.num_rows, bool)
        for k in keys:
            v = whole.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield whole.slice(0, last)
        held = whole.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after the pairs (a, b) are linked too; ``label`` has the least member of each group so far."""
    if not len(a):
        return label
    least, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    new = np.arange(len(label))
    new[least] = least[_least_labels(len(least), at[: len(a)], at[len(a) :])]
    return new[label]


def _similar(percent: int):
    """First-level regions (sorted by code, chain, n) to groups of members that may link. Pairs join the labels
    as they are found and are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["code", "chain"]):
            code, chain = t.column("code").to_numpy(), t.column("chain").to_numpy()
            sig, n = t.column("sig").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            cell = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]) | (chain[1:] != chain[:-1])]))
            kinds = np.frombuffer(b"".join(t.column("classes").to_pylist()), np.uint8).reshape(-1, CLASSES)
            label = np.arange(len(n))
            at, step = np.arange(len(n)), 1
            while len(at):
                at = at[at + step < len(n)]
                at = at[cell[at] == cell[at + step]]
                at = at[100 * n[at] >= percent * n[at + step]]  # by rising n: once too far, always
                for part in np.array_split(at, max(1, len(at) // 20_000)):
                    part = part[label[part] != label[part + step]]  # those of one group need no test
                    other = part + step
                    # |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|), and class counts differ by no more
                    apart = np.maximum(kinds[part], kinds[other]) - np.minimum(kinds[part], kinds[other])
                    near = (100 + percent) * apart.sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[part] + n[other])
                    label = _joined(label, part[near], other[near])
                step += 1
            member = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            least = sig.copy()
            np.minimum.at(least, label[member], sig[member])
            yield pa.RecordBatch.from_arrays([pa.array(least[label[member]]), pa.array(sig[member])], ["region", "sig"])

    return run


def join_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links among ``sets`` that have the same components as all pairs with J >= percent / 100."""
    size = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(size) - size
    _, held = np.unique(np.concatenate(sets), return_inverse=True)
    n_codes = int(held.max()) + 1 if len(held) else 0
    links: list[tuple[int, int]] = []
    mark = np.zeros(n_codes, np.int32)

    def gather(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(size[members])
        starts = ends - size[members]
        return held[np.arange(ends[-1]) - np.repeat(starts - first[members], size[members])], starts

    def common(x: int, members: np.ndarray) -> np.ndarray:
        mine = held[first[x] : first[x] + size[x]]
        mark[mine] = 1
        codes, starts = gather(members)
        out = np.add.reduceat(mark[codes], starts)
        mark[mine] = 0
        return out

    def linked(x: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = common(x, members).astype(np.int64)
        outer = size[members] + size[x] - inner
        return 100 * inner >= percent * outer, 1 - inner / outer

    eps = 1 - percent / 100
    todo = [np.flatnonzero(size > 0)]
    while todo:
        members = todo.pop()
        if len(members) < 2:
            continue
        if len(members) == 2:
            if linked(members[0], members[1:])[0][0]:
                links.append((members[0], members[1]))
            continue
        codes, starts = gather(members)
        usual = 2 * np.bincount(codes, minlength=n_codes) >= len(members)
        shared = np.add.reduceat(usual[codes].astype(np.int64), starts)
        pivot = members[np.argmax(shared / (size[members] + usual.sum() - shared))]
        near, d = linked(pivot, members)
        reached, rest, d_reached, d_rest = members[near], members[~near], d[near], d[~near]
        links += [(pivot, x) for x in reached if x != pivot]
        for x, dx in zip(rest, d_rest, strict=True):
            if dx <= 2 * eps + 1e-9:
                window = reached[d_reached >= dx - eps - 1e-9]
                if len(window):
                    hit = np.flatnonzero(linked(x, window)[0])
                    if len(hit):
                        links.append((x, window[hit[0]]))
        order = np.argsort(d_rest)
        cuts = np.flatnonzero(np.diff(d_rest[order]) > eps + 1e-9) + 1
        todo += np.split(rest[order], cuts)
    return links


def _join_regions(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["region", "part"], 2_000):
            region, part, sig = (t.column(k).to_numpy() for k in ("region", "part", "sig"))
            once = np.ones(len(sig), bool)  # copies of a set may have come along
            once[1:] = (region[1:] != region[:-1]) | (part[1:] != part[:-1]) | (sig[1:] != sig[:-1])
            region, part, sig = region[once], part[once], sig[once]
            sets = [np.frombuffer(x, np.uint64) for x in t.column("codes").filter(pa.array(once)).to_pylist()]
            edges = [0, *(np.flatnonzero((region[1:] != region[:-1]) | (part[1:] != part[:-1])) + 1), len(sig)]
            a, b = [], []
            for i, k in zip(edges[:-1], edges[1:], strict=True):
                for x, y in join_sets(sets[i:k], percent):
                    a.append(sig[i + x]), b.append(sig[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


# ------------------------------------------------------------------------------ groups too large


def _dealt(percent: int):
    """Members of a group (a slice of them) and its pivots to (region, part, sig, d, owner, linked): the parts of each member,
    its distance to the pivot, whether that is its nearest, and whether it is of the one component of the members linked there."""
    eps = 1 - percent / 100

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in pivots.column("codes").to_pylist()]
        if sets:
            codes, count = np.unique(np.concatenate(sets), return_counts=True)
            sets.append(codes[2 * count >= len(sets)])
        out: dict[str, list] = {"region": [], "part": [], "sig": [], "d": [], "owner": [], "linked": []}
        region = members.column("region")[0].as_py() if members.num_rows else 0
        for sig, mine in zip(members.column("sig").to_pylist(), members.column("codes").to_pylist(), strict=True):
            mine = np.frombuffer(mine, np.uint64)
            inner = np.array([len(np.intersect1d(mine, x, assume_unique=True)) for x in sets])
            outer = np.array([len(x) for x in sets]) + len(mine) - inner
            d = 1 - inner / outer
            linked = 100 * inner >= percent * outer
            linked[-1] = 200 * (outer[-1] - inner[-1]) <= (100 - percent) * outer[-1]
            for k in np.flatnonzero(d <= d.min() + 2 * eps + 1e-9):
                out["region"].append(region), out["part"].append(int(k)), out["sig"].append(sig), out["d"].append(float(d[k])), out["owner"].append(bool(k == d.argmin())), out["linked"].append(bool(linked[k]))
        return pa.Table.from_pydict(out, pa.schema([("region", pa.int64()), ("part", pa.int64()), ("sig", pa.int64()), ("d", pa.float64()), ("owner", pa.bool_()), ("linked", pa.bool_())]))

    return run


def _round(groups: DataFrame, large: DataFrame, payload: DataFrame, percent: int, k: int, n_pivots: int, most_slice: int) -> DataFrame:
    """The groups of ``large`` (region, n) dealt to their pivots, as ``_dealt`` says."""
    inside = groups.join(large, "region")
    hashed = F.xxhash64("sig", F.lit(k))
    pivots = stage(
        inside.groupBy("region", F.pmod(hashed, F.lit(n_pivots)).alias("slot")).agg(F.min(F.struct(hashed.alias("h"), "sig"))["sig"].alias("sig"), F.first("n").alias("n"))
        .join(payload, "sig").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / most_slice))))
        .select("region", "slice", "codes"),
        "pivots",
    )
    members = inside.join(payload, "sig").withColumn("slice", F.pmod(F.xxhash64("sig", F.lit(-1)), F.floor(F.col("n") / most_slice) + 1))
    return stage(
        members.select("region", "slice", "sig", "codes").groupBy("region", "slice").cogroup(pivots.groupBy("region", "slice"))
        .applyInArrow(_dealt(percent), "region long, part long, sig long, d double, owner boolean, linked boolean"),
        "voronoi",
    )


def _deal_out(regions: DataFrame, payload: DataFrame, most: int, percent: int, n_pivots: int = 32, most_slice: int = 2_000) -> tuple[DataFrame, DataFrame | None]:
    """(region, part, sig) with no part above ``most`` members, and links (a, b) found on the way, if any."""
    groups, parts, links, k = regions, [], [], 0
    blocks = regions.limit(0).select("region", "sig", F.lit(0).cast("long").alias("n"))
    while True:
        large = groups.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        if large.isEmpty():
            break
        large = stage(large, "large")
        parts.append(groups.join(large, "region", "left_anti"))
        dealt = _round(groups, large, payload, percent, k, n_pivots, most_slice)
        reps = dealt.filter("linked").groupBy("region", "part").agg(F.min("sig").alias("a"))
        links.append(dealt.filter("linked").join(reps, ["region", "part"]).select("a", F.col("sig").alias("b")))
        # Each linked pair meets in the part of the nearest pivot of either. Tests are needed there of the owners, and of the members
        # that are not linked to the pivot; the fewer of the two are active, and passive members need no test among each other.
        kinds = dealt.groupBy("region", "part").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("far"), F.count_if(~F.col("linked")).alias("u"), F.count_if("owner").alias("o"))
        left = dealt.join(kinds.filter("u > 0 AND o > 0"), ["region", "part"]).filter(f"u > o OR NOT linked OR d >= far - {1 - percent / 100} - 1e-9")
        left = stage(left.select("region", "part", "sig", F.when(F.col("u") <= F.col("o"), F.col("linked")).otherwise(~F.col("owner")).alias("passive")), "left")
        sizes = left.groupBy("region", "part").agg(F.count("*").alias("m"), F.count_if(~F.col("passive")).alias("s"))
        # A part that holds few active members is cut into slices of the others that each have these.
        cut = (F.col("m") > most) & (4 * F.col("s") <= most)
        whole = sizes.filter(~cut).groupBy("region").agg(F.max("m").alias("m"), F.sum("m").alias("total"))
        halved = F.col("m").isNull() | (F.col("m") <= most) | ((2 * F.col("m") <= F.col("n")) & (F.col("total") <= 4 * F.col("n")))
        state = stage(large.join(whole, "region", "left").select("region", "n", halved.alias("halved")), "halved")
        blocks = blocks.unionByName(groups.join(state.filter("NOT halved").select("region", "n"), "region").select("region", "sig", "n"))
        going_on = left.join(state.filter("halved").select("region"), "region", "left_semi")
        slices = sizes.filter(cut).select("region", "part", F.ceil(2 * F.col("m") / most).alias("slices"))
        mine = F.when(F.col("passive"), F.array(F.pmod(F.xxhash64("sig"), F.col("slices")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
        sliced = going_on.join(slices, ["region", "part"]).withColumn("slice", F.explode(mine))
        parts.append(sliced.select(F.xxhash64("region", "part", "slice", F.lit(k)).alias("region"), "sig"))
        groups = going_on.join(slices, ["region", "part"], "left_anti").select(F.xxhash64("region", "part", F.lit(k)).alias("region"), "sig")
        k += 1
    found = groups
    for x in parts:
        found = found.unionByName(x.select("region", "sig"))
    found = found.select("region", F.lit(0).cast("long").alias("part"), "sig")
    if not k:
        return found, None
    # Blocks i <= j of a group meet in the part (i, j): every pair of members meets in one of them.
    blocked = (
        blocks.withColumn("blocks", F.ceil(2 * F.col("n") / most)).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("region", (-1 - F.pmod(F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")), F.lit(1 << 60))).alias("part"), "sig")
    )
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return found.unionByName(blocked), every


# ------------------------------------------------------------------------------------- the join


def jaccard_components(docs: DataFrame, percent: int = PERCENT, max_region: int = MAX_REGION, max_tested: int = MAX_TESTED, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(docs.mapInArrow(_signatures(width), "doc_id long, n long, sig long, classes binary"), "sets")

    chunks = stage(docs.mapInArrow(chunks_of(CHUNK_BYTES), CHUNK), "chunks")
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(40, min(64, total.bit_length() + 10))
    asked = chunks.mapInArrow(_asked(width, bits, max(LEAST_BUCKETS, total // BUCKET)), "bucket long, chunk long, keys binary, counts binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_counted, "chunk long, bucket long, counts binary"), "counts")
    prefixes = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(percent, width, bits), "code long, sig long, n int")

    by_n = Window.partitionBy("code").orderBy("n", "sig")
    before, after = F.lag("n").over(by_n), F.lead("n").over(by_n)
    begins = before.isNull() | (100 * before < percent * F.col("n"))
    ends = after.isNull() | (100 * F.col("n") < percent * after)
    cells = stage(
        prefixes.repartition("code").dropDuplicates(["code", "sig"])
        .withColumn("begins", begins).withColumn("ends", ends)
        .withColumn("chain", F.sum(F.col("begins").cast("int")).over(by_n))
        .filter(~(F.col("begins") & F.col("ends"))).select("code", "chain", "sig", "n"),
        "cells",
    )
    # Regions of the same members are one region.
    same = cells.groupBy("code", "chain").agg(
        F.count("*").alias("k"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y")
    )
    one = stage(same.groupBy("k", "x", "y").agg(F.min(F.struct("code", "chain")).alias("cell")).select("cell.code", "cell.chain", "k"), "distinct-cells")
    classes = sets.dropDuplicates(["sig"]).select("sig", "classes")
    tested = (
        cells.join(one.filter(F.col("k") <= max_tested).drop("k"), ["code", "chain"]).join(classes, "sig")
        .repartition("code").sortWithinPartitions("code", "chain", "n")
        .mapInArrow(_similar(percent), "region long, sig long").distinct()
    )
    large = cells.join(one.filter(F.col("k") > max_tested).drop("k"), ["code", "chain"])
    regions = stage(tested.union(large.select(F.xxhash64("code", "chain").alias("region"), "sig")), "regions")

    firsts = sets.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    wanted = stage(firsts.join(regions.select("sig").distinct(), "sig", "left_semi").select("rep"), "wanted")
    needed = docs.join(few(wanted), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    payload = stage(needed.mapInArrow(_payload(width), "sig long, codes binary"), "payload")
    parts, known_links = _deal_out(regions, payload, max_region, percent)
    links = (
        parts.join(payload, "sig").repartition("region", "part").sortWithinPartitions("region", "part", "sig")
        .select("region", "part", "sig", "codes").mapInArrow(_join_regions(percent), "a long, b long")
    )
    links = stage((links if known_links is None else links.unionByName(known_links)).distinct(), "set-links")
    # Sets are linked by signature, since a set may have no doc_id; a component then takes the smallest doc_id of its sets.
    found = components(links)
    members = stage(found.join(firsts, F.col("node") == F.col("sig")).select("sig", "label", "rep"), "members")
    least = members.groupBy("label").agg(F.min("rep").alias("least"))
    linked = members.join(least, "label").select("sig", "least")
    label = firsts.join(linked, "sig", "left").select("sig", F.coalesce("least", "rep").alias("label"))
    return sets.select("doc_id", "n", "sig").join(label, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label")).alias("component_id")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles, sh FROM s),
e AS (SELECT doc_id, n_shingles, unnest(sh) AS g FROM n),
r AS (SELECT doc_id, n_shingles, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k
      FROM (SELECT *, count(*) OVER (PARTITION BY g) AS f FROM e)),
p AS (SELECT * FROM r WHERE k <= n_shingles - (90 * n_shingles + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
      WHERE 190 * len(list_intersect(x.sh, y.sh)) >= 90 * (x.n_shingles + y.n_shingles)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS to_node FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.to_node = both_ways.a)
SELECT n.doc_id, n.n_shingles, coalesce(m.least, n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT node, min(to_node) AS least FROM reach GROUP BY node) m ON m.node = n.doc_id
"""
