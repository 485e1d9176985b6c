import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import ngram_join
from skylattice.llm.components import components

from .conftest import prose


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return sorted(out, key=str)


def run(df, **how):
    return sorted(map(tuple, ngram_join.jaccard_components(df, **how).collect()), key=str)


def test_odd_rows(frame, odd_docs):
    assert run(frame(odd_docs)) == brute(odd_docs)


def test_empty_table(frame):
    assert run(frame([])) == []


def test_a_null_doc_id_links_others(frame):
    """A (without doc_id) links with B and with C, B not with C."""
    a = prose(50, 80)
    b, c = [*a[:-1], "b1"], ["c1", *a[1:]]
    b[40], c[20] = "b2", "c2"
    assert not 100 * len(shingles(" ".join(b)) & shingles(" ".join(c))) >= 90 * len(shingles(" ".join(b)) | shingles(" ".join(c)))
    rows = [(None, " ".join(a), "en", "a"), (5, " ".join(b), "en", "a"), (7, " ".join(c), "en", "a"), (None, "alone without any id here", "en", "a")]
    want = brute(rows)
    assert [r[2] for r in want if r[1] > 10] == [5, 5, 5]
    assert run(frame(rows)) == want
    assert run(frame([(None, t, x, y) for _, t, x, y in rows])) == brute([(None, t, x, y) for _, t, x, y in rows])


def clusters():
    rows = []
    for c in range(6):
        base = prose(100 + c, 90)
        for k in range(25):
            words = list(base)
            for e in range(k % 5):
                words[(7 * k + 13 * e) % 90] = f"e{c}-{k}-{e}"
            rows.append((1000 * c + k, " ".join(words), "en", "a"))
    return rows


def test_groups_of_near_copies(frame):
    assert run(frame(clusters())) == brute(clusters())


@pytest.mark.parametrize("most", [3, 10])
def test_large_groups_are_dealt_out(frame, most):
    """Voronoi regions and pairs of blocks give the same components as one task."""
    assert run(frame(clusters()), max_region=most) == brute(clusters())


def test_large_first_regions_are_dealt_out(frame):
    assert run(frame(clusters()), max_region=8, max_tested=2) == brute(clusters())


def test_rounds_link_a_large_group_and_leave_little(spark):
    """Near copies of one text are linked by the first round; members at the edge of it go on."""
    draw = np.random.default_rng(8)
    base, sets = draw.choice(100_000, 200, replace=False), {}
    for k in range(300):
        x = base.copy()
        n = k % 4 if k < 290 else 12
        x[draw.choice(200, n, replace=False)] = 200_000 + draw.choice(100_000, n, replace=False)
        sets[k] = np.unique(x).astype(np.uint64)
    payload = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "sig long, codes binary")
    regions = spark.createDataFrame([(1, k) for k in sets], "region long, sig long")
    parts, links = ngram_join._deal_out(regions, payload, 40, 90, n_pivots=4, most_slice=50)
    held = [sorted(r["x"]) for r in parts.groupBy("region", "part").agg(F.collect_list("sig").alias("x")).collect()]
    known = {tuple(sorted(r)) for r in links.collect()}
    inside = [(a, b) for rows in held for a, b in ngram_pairs(rows, sets)]
    every = [(a, b) for a in sets for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))]

    def roots(pairs):
        label = list(range(300))
        for _ in range(12):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert max(map(len, held), default=0) <= 45  # slices are dealt by hash
    assert sum(map(len, held)) < 1500  # pairs of the 15 blocks would hold 4,500
    assert roots([*known, *inside]) == roots(every)


def ngram_pairs(rows, sets):
    return [(rows[i], rows[j]) for i, j in ngram_join.join_sets([sets[k] for k in rows])]


def test_local_join_is_exact():
    draw = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = draw.choice(100_000, 60, replace=False)
        for _ in range(12):
            s = base.copy()
            s[draw.integers(0, 60, draw.integers(0, 5))] = draw.integers(0, 100_000)
            sets.append(np.unique(s).astype(np.uint64))

    def roots(links):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    links = ngram_join.join_sets(sets)
    assert {(max(a, b), min(a, b)) for a, b in links} <= set(every)
    assert roots(links) == roots(every)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (None, 3), (7, 7)], "a long, b long")
    found = dict(components(links).collect())
    assert found == dict.fromkeys(range(61), 0) | {200: 200, 201: 200}


def test_five_words_and_eighty_percent_dealt_out(frame):
    """Links at 80 in groups that are dealt out."""
    rows = clusters()
    sets = {r[0]: (lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})(r[1].split()) for r in rows}
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if all(least[least[k]] == least[k] for k in least):
            break
    want = sorted((k, len(sets[k]), least[k]) for k in sets)
    for how in ({}, {"max_region": 6, "max_tested": 4}):
        assert sorted(run(frame(rows), percent=80, width=5, **how)) == want


def test_pipeline_stage_takes_five_words_and_eighty_percent(spark, frame):
    import corpus_pipeline

    base = prose(400, 54)
    changed = base[:27] + ["other"] + base[28:]
    rows = [(1, " ".join(base), "en", "a"), (2, " ".join(changed), "en", "a"), (3, " ".join(prose(401, 54)), "en", "a")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(rows), "").collect()) == [1, 3]


def test_first_level_keeps_members_and_no_pairs():
    """3,000 near copies are 4.5 million pairs, 72 MB of indices."""
    n = 3000
    kinds = np.ones(ngram_join.CLASSES, np.uint8).tobytes()
    alone = np.full(ngram_join.CLASSES, 9, np.uint8).tobytes()
    batch = pa.RecordBatch.from_pydict(
        {"code": [7] * (n + 1), "chain": [1] * (n + 1), "sig": list(range(n + 1)), "n": [256] * (n + 1), "classes": [kinds] * n + [alone]},
        pa.schema([("code", pa.int64()), ("chain", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("classes", pa.binary())]),
    )
    tracemalloc.start()
    (found,) = ngram_join._similar(90)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("sig").to_pylist() == list(range(n)) and set(found.column("region").to_pylist()) == {0}
    assert peak < 30e6


@pytest.mark.parametrize("at_once", [7, 250_000])
def test_buckets_count_what_chunks_hold(monkeypatch, at_once):
    monkeypatch.setattr(ngram_join, "AT_ONCE", at_once)
    draw = np.random.default_rng(5)
    held = [np.unique(draw.integers(1 << 63, (1 << 63) + 60, 25, dtype=np.uint64)) for _ in range(12)] + [np.array([3], np.uint64)]
    counts = [draw.integers(1, 400 if k == 0 else 4, len(x)) for k, x in enumerate(held)]
    want = {}
    for x, n in zip(held, counts, strict=True):
        for key, c in zip(x.tolist(), n.tolist(), strict=True):
            want[key] = want.get(key, 0) + c
    sent = [pa.array([ngram_join.packed(v) for v in values], pa.binary()) for values in ([np.diff(x, prepend=np.uint64(0)) for x in held], counts)]
    t = pa.table([pa.array(range(len(held))), pa.array([0] * len(held)), *sent], ["chunk", "bucket", "keys", "counts"])
    got = [ngram_join.unpacked(x).tolist() for x in ngram_join._counted(t).column("counts").to_pylist()]
    assert got == [[min(want[key], 255) for key in x.tolist()] for x in held]


def test_labels_join_as_pairs_come():
    draw = np.random.default_rng(3)
    for _ in range(30):
        a, b = draw.integers(0, 60, (2, 45))
        label = np.arange(60)
        for k in range(0, 45, 5):
            label = ngram_join._joined(label, a[k : k + 5], b[k : k + 5])
        assert (label == ngram_join._least_labels(60, a, b)).all()
