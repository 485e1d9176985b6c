import math
from fractions import Fraction

import numpy as np
import pytest

from skylattice.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, v int, component string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "x") for r in rows], SCHEMA).repartition(3)


def brute_polynomial(M):
    """Faddeev-LeVerrier over fractions."""
    d = len(M)
    c, B = [Fraction(0)] * d + [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        B = [[sum(M[i][t] * B[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(sum(M[i][t] * B[t][i] for t in range(d)) for i in range(d)) / k
    return [int(x) for x in c]


def gram(seed, d, n, top=50):
    x = np.random.default_rng(seed).integers(-top, top, (n, d))
    return (x.T @ x).tolist()


@pytest.mark.parametrize("M", [gram(1, 5, 9), gram(2, 8, 4), [[3]], [[0, 0], [0, 0]], np.diag([5, 5, 5, 2]).tolist(), gram(3, 9, 30, 10**5)])
def test_polynomial(spark, M):
    assert wh.characteristic(spark, M)[0] == brute_polynomial(M)


def test_a_pivot_that_is_zero():
    a = np.array([[1, 0, 2], [0, 3, 1], [2, 1, 4]], np.int64)
    p = 101
    h = wh.hessenberg(a, p)
    assert h[2, 0] == 0
    assert [int(x) for x in wh.polynomial_modulo(a, p)] == [x % p for x in brute_polynomial(a.tolist())]


def from_roots(roots):
    q = [1]
    for r in roots:
        q = [(q[k - 1] if k else 0) - r * (q[k] if k < len(q) else 0) for k in range(len(q) + 1)]
    return q


def test_roots():
    q = from_roots([7, 7, 3, 10**9, 10**9 + 1, 1])
    assert [wh.above(q, Fraction(a)) for a in (0, 1, 3, 7, 10**9, 10**9 + 1)] == [6, 5, 4, 2, 1, 0]
    found = wh.largest_roots(q, 6)
    assert [m for _, m in found] == [1, 1, 1 + 1, 1, 1]
    assert all(abs(x - y) < y * Fraction(1, 1 << 150) for (x, _), y in zip(found, (10**9 + 1, 10**9, 7, 3, 1), strict=True))
    assert len(wh.largest_roots(q, 2)) == 2


def test_close_roots_and_derivative():
    p = (1 << 31) - 1
    assert wh.coprime_with_derivative(np.array([x % p for x in from_roots([1, 2, 3])]), p)
    assert not wh.coprime_with_derivative(np.array([x % p for x in from_roots([1, 2, 2])]), p)
    root = 1 << 400
    found = wh.largest_roots(from_roots([root, root + 1]), 2, simple=True)
    assert [m for _, m in found] == [1, 1]


def check(spark, rows, most=8):
    """Against numpy in doubles and exact sums."""
    found = wh.whiten(frame_of(spark, rows), most=most).collect()
    left = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in left]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x, strict=True)]
    far = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    white = np.array([[float(Fraction(c, n)) for c in v] for v in far])
    V = white.T @ white / n
    values, vectors = np.linalg.eigh(V)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, d)
    assert len(found) == n * k
    want = {}
    for (i, _), f, w in zip(left, far, white, strict=True):
        for c in range(k):
            want.setdefault((str(i), c + 1), []).append((n, sum(a * a for a in f), float(w @ vectors[:, c]) / math.sqrt(values[c]), values[c] / values.sum()))
    signs = {}
    for r in sorted(found, key=lambda r: -abs(r["whitened"])):
        options = want[str(r["vec_id"]), r["component"]]
        n_, deviation, w, e = min(options, key=lambda o: abs(o[1] - r["deviation"]))
        sign = signs.setdefault(r["component"], 1 if r["whitened"] * w > 0 else -1)
        assert r["n"] == n_ and int(r["deviation"]) == deviation
        assert r["whitened"] == pytest.approx(sign * w, abs=1e-7)
        assert r["explained"] == pytest.approx(e, rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in found}) == 1


def vectors(seed, n, d, first=0):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.linspace(1, 3, d)
    return [(first + i, [float(c) for c in row]) for i, row in enumerate(x)]


def test_rows(spark):
    rows = vectors(1, 60, 12)
    rows += [(100, None), (101, [None] + [0.5] * 11), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (None, [0.25] * 12), (3, rows[3][1]), (3, rows[3][1])]
    check(spark, rows)


def test_few_entries_and_far_values(spark):
    check(spark, vectors(2, 30, 3))
    check(spark, [(i, [1e6 * c for c in v]) for i, v in vectors(3, 20, 4)])


def test_other_lengths_are_dropped(spark):
    rows = vectors(4, 20, 5)
    found = wh.whiten(frame_of(spark, rows + [(77, [1.0, 2.0]), (78, [])])).collect()
    assert {r["vec_id"] for r in found} == set(range(20)) and {r["n"] for r in found} == {20}


def test_multiple_roots_and_rank(spark):
    # The corners of a cross: every direction has the same variance.
    rows = [(2 * k + s, [0.0] * k + [1.0 if s else -1.0] + [0.0] * (3 - k)) for k in range(4) for s in range(2)]
    found = wh.whiten(frame_of(spark, rows)).collect()
    assert len(found) == 8 * 4 and all(r["explained"] == 0.25 and r["identity_error"] < 1e-12 for r in found)
    # Rank 2 in five dimensions gives two components.
    flat = [(i, [float(a), float(b), float(a + b), float(a - b), 0.0]) for i, (a, b) in enumerate([(1, 2), (3, -1), (0, 5), (2, 2), (-4, 1)])]
    found = wh.whiten(frame_of(spark, flat)).collect()
    assert {r["component"] for r in found} == {1, 2} and sum(r["explained"] for r in found) == pytest.approx(5.0)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert wh.whiten(frame_of(spark, rows)).count() == 0


def test_sums_beyond_longs(spark):
    rows = [(i, [1e14 * ((i * 7) % 5), -2e14 * i]) for i in range(6)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    df, d = wh.vectors_of(frame_of(spark, rows))
    n, sums, _, M = wh.scatter(df, d)
    assert n == 6 and sums == [sum(c) for c in zip(*x, strict=True)]
    assert M == [[n * sum(a[i] * a[j] for a in x) - sums[i] * sums[j] for j in range(2)] for i in range(2)]


def test_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check(spark, rows)
    assert wh.op13_embedding_whitening(spark, data).filter("deviation IS NULL OR deviation <> deviation_exact").isEmpty()
