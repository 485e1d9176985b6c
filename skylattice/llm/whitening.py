"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers, so n, the sums S and the scatter M = n * sum (x - m)(x - m)' - (S - n m)(S - n m)' are exact for any
integer centre m; m is the rounded mean, so numbers stay small. M is n^2 times the covariance V. Tasks add up exact blocks, Spark
adds the tasks, and the driver sees one number for each pair of dimensions.

The characteristic polynomial of M is found modulo many primes, each by a task of its own: M is brought to Hessenberg form by
row and column operations, and the recurrence of its leading minors gives the polynomial. Maclaurin's inequality bounds the
coefficients by the trace, primes are taken until their product is beyond that bound, and Chinese remaindering gives the integers.

All roots are real, so Descartes' rule is exact: the sign changes of q(t + a) count the roots above a, multiple ones as often as
they occur. Bisection by that count isolates the largest roots, and by the sign of q at dyadic points narrows them to ``BITS``
bits. If q and its derivative are coprime modulo a prime, all roots are simple and are isolated however close they lie; else roots
closer than ``BITS`` bits are one multiple root.

A component is a null vector of M - e I by inverse iteration in fixed-point integers of 3 * ``BITS`` bits; multiple roots take as many
vectors, made orthogonal. The result is rounded to doubles at the end.

Defined cases: a vector that is null or has null or non-finite entries is dropped; so are vectors of another number of entries
than most have (of two numbers as frequent the larger counts); entries are held within 2^61; components end where eigenvalues are 0,
so equal vectors, one vector or none give no rows; equal eigenvalues have some orthonormal components, the same for all rows;
a null vec_id stays null; repeated rows count and return each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Relative precision of a root, in bits; vectors are solved for with three times as many.
BITS = 192
SUMS = "i int, j int, total decimal(38,0)"
WHITE = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


# ------------------------------------------------------------------------------ exact sums, on Spark


def vectors_of(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that remain, and the number of their entries."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = top[0]["d"] if top else 0
    return rows.filter(F.size("v") == d), d


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -(2.0**61), 2.0**61).astype(np.int64).reshape(batch.num_rows, d) + SHIFT


def _exact_product(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers as Python integers."""
    top = int(max(abs(int(x.min())), abs(int(x.max())), 1))
    rows = (1 << 53) // (top * top)
    if rows < 16:
        x = x.astype(object)
        return x.T.dot(x)
    out = np.zeros((x.shape[1],) * 2, object)
    for a in range(0, len(x), min(rows, 1 << 16)):  # sums of doubles below 2^53 are exact
        part = x[a : a + min(rows, 1 << 16)].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _sums(d: int, centre: list[int] | None):
    """Sums of the entries (no centre), or of the products of entries less the centre, one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d if centre is None else (d, d), object)
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch, d)
                if centre is None:
                    small = abs(x).max() < 1 << 40
                    total += (x if small else x.astype(object)).sum(axis=0).astype(object)
                else:
                    total += _exact_product(x - np.array(centre, np.int64))
        i, j = (np.arange(d), np.zeros(d, np.int64)) if centre is None else np.triu_indices(d)
        values = [int(x) for x in (total if centre is None else total[i, j])]
        limbs = _limbs(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(i, 4), pa.int32()), pa.array(np.repeat(j, 4) * 4 + np.tile(np.arange(4), d if centre is None else len(i)), pa.int32()), pa.array(limbs, pa.decimal128(38, 0))],
            ["i", "j", "total"],
        )

    return run


#: A whole number goes through Spark's sums in four limbs of so many bits, the last one signed and without bound.
LIMB = 64


def _limbs(values: list[int]) -> list:
    from decimal import Decimal

    out = []
    for x in values:
        for _ in range(3):
            out.append(Decimal(x & ((1 << LIMB) - 1)))
            x >>= LIMB
        out.append(Decimal(x))
    return out


def _added(rows: DataFrame, d: int, centre: list[int] | None) -> dict[tuple[int, int], int]:
    found = rows.select("v").mapInArrow(_sums(d, centre), SUMS).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in found:
        at = (r["i"], r["j"] // 4)
        out[at] = out.get(at, 0) + (int(r["total"]) << (LIMB * (r["j"] % 4)))
    return out


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[int], list[list[int]]]:
    """n, the sums S, the centre m and the scatter M of vectors of d entries."""
    n = rows.count()
    if not n or not d:
        return n, [0] * d, [0] * d, [[0] * d for _ in range(d)]
    sums = [_s for _, _s in sorted(_added(rows, d, None).items())]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _added(rows, d, centre)
    off = [s - n * m for s, m in zip(sums, centre, strict=True)]
    M = [[n * products[min(i, j), max(i, j)] - off[i] * off[j] for j in range(d)] for i in range(d)]
    return n, sums, centre, M


# ------------------------------------------------------------ characteristic polynomial, by primes


def _is_prime(n: int) -> bool:
    """Below 3.2 * 10^9 the bases 2, 3, 5, 7 decide."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, from the top, whose product is beyond ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo the prime ``p`` with zeros below the first subdiagonal."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        at = np.flatnonzero(h[k + 1 :, k])
        if not len(at):
            continue
        i = k + 1 + at[0]
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    return h


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo ``p``, the constant first."""
    h, d = hessenberg(a, p), len(a)
    minors = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    minors[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = minors[k, :-1]
        weight, below = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):  # the product of the subdiagonal between i and k
            weight[i] = h[i, k] * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        minors[k + 1] = (new - (weight[:, None] * minors[: k + 1] % p).sum(axis=0)) % p
    return minors[d]


def coprime_with_derivative(coefficients: np.ndarray, p: int) -> bool:
    """Whether a polynomial modulo ``p`` (constant first) has no factor with its derivative; then all its roots are simple."""
    a = [int(x) for x in coefficients]
    b = [k * x % p for k, x in enumerate(a)][1:]
    while b and not b[-1]:
        b.pop()
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            q = a[-1] * inverse % p
            for k, x in enumerate(b):
                a[len(a) - len(b) + k] = (a[len(a) - len(b) + k] - q * x) % p
            a.pop()
        while a and not a[-1]:
            a.pop()
        a, b = b, a
    return len(a) == 1


def _modulo(M: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                q = polynomial_modulo(np.array([[x % p for x in row] for row in M], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([q.tolist()], pa.list_(pa.int64())), pa.array([coprime_with_derivative(q, p)])], ["p", "q", "simple"])

    return run


def characteristic(spark: SparkSession, M: list[list[int]]) -> tuple[list[int], bool]:
    """The integer coefficients of det(t I - M), the constant first, for a positive semidefinite M, and whether
    its roots are proven to be simple. Each prime is a row of a table."""
    d, trace = len(M), sum(M[i][i] for i in range(len(M)))
    bound = max(math.comb(d, k) * (-(-trace**k // d**k)) for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = sorted(rows.mapInArrow(_modulo(M), "p long, q array<long>, simple boolean").collect())
    total = math.prod(p for p, *_ in found)
    share = [(total // p) * pow(total // p, -1, p) for p, *_ in found]
    out = [sum(q[k] * s for (_, q, _), s in zip(found, share, strict=True)) % total for k in range(d + 1)]
    return [x - total if 2 * x > total else x for x in out], any(simple for *_, simple in found)


# ---------------------------------------------------------------------------- roots and components


def shifted(q: list[int], a: Fraction) -> list[int]:
    """q(t + a), up to a positive factor of t and of all: with a = m / 2^s the roots of the result are 2^s (root - a)."""
    s, m = a.denominator.bit_length() - 1, a.numerator
    c = [x << (s * (len(q) - 1 - k)) for k, x in enumerate(q)]
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            c[j] += m * c[j + 1]
    return c


def above(q: list[int], a: Fraction) -> int:
    """The number of roots above ``a`` of a polynomial with real roots only."""
    signs = [x > 0 for x in shifted(q, a) if x]
    return sum(x != y for x, y in zip(signs[:-1], signs[1:], strict=True))


def _sign(q: list[int], a: Fraction) -> int:
    s, m, value = a.denominator.bit_length() - 1, a.numerator, 0
    for k, x in enumerate(reversed(q)):
        value = value * m + (x << (s * k))
    return (value > 0) - (value < 0)


def largest_roots(q: list[int], most: int, simple: bool = False, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of positive roots from the largest down, until ``most`` are counted, to a relative error of 2^-bits."""
    if len(q) < 2:
        return []
    top = Fraction(1 << (abs(q[-2]).bit_length() + 1))  # q is monic: no root is above their sum
    open_, out, counted = [(Fraction(0), top, above(q, Fraction(0)), 0)], [], 0
    while open_ and counted < most:
        low, high, at_low, at_high = open_.pop()
        while True:
            narrow = low > 0 and (high - low) * (1 << bits) < low
            if at_low - at_high == 0 or narrow and (not simple or at_low - at_high == 1):
                break
            middle = (low + high) / 2
            if at_low - at_high == 1:
                sign = _sign(q, middle)
                if sign == 0:
                    low = high = middle
                    break
                # The sign at a point is that of (-1) ** (roots above it).
                if (sign > 0) == (at_high % 2 == 0):
                    high = middle
                else:
                    low = middle
                continue
            at_middle = above(q, middle)
            open_.append((low, middle, at_low, at_middle))
            low, at_low = middle, at_middle
        if at_low > at_high:
            out.append(((low + high) / 2, at_low - at_high))
            counted += at_low - at_high
    return out


def _null_vectors(M: list[list[int]], root: Fraction, count: int, bits: int) -> list[list[int]]:
    """``count`` orthonormal vectors, times 2^bits, that M - root I takes to nearly 0."""
    d = len(M)
    size = max(1, max(abs(x) for row in M for x in row)).bit_length()
    a = np.array([[(x << bits) >> size for x in row] for row in M], object)
    e = (root.numerator << bits) // (root.denominator << size)
    for i in range(d):
        a[i, i] -= e
    # Fixed vectors to start from, one column each.
    b = np.array([[(((i + 1) * 0x9E3779B97F4A7C15 * (2 * k + 3)) % (1 << 61) - (1 << 60)) << (bits - 60) for k in range(count)] for i in range(d)], object)
    upper, steps = a, []
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(upper[i, k]))
        if at != k:
            upper[[at, k]] = upper[[k, at]]
        steps.append((at, None))
        if not upper[k, k]:
            upper[k, k] = 1
        if k + 1 < d:
            f = (upper[k + 1 :, k] << bits) // upper[k, k]
            upper[k + 1 :, k:] -= (f[:, None] * upper[k, k:]) >> bits
            steps[-1] = (at, f)
    for _ in range(2):
        for k, (at, f) in enumerate(steps):
            if at != k:
                b[[at, k]] = b[[k, at]]
            if f is not None:
                b[k + 1 :] -= (f[:, None] * b[k]) >> bits
        for k in range(d - 1, -1, -1):
            rest = b[k] - (((upper[k, k + 1 :, None] * b[k + 1 :]).sum(axis=0) >> bits) if k + 1 < d else 0)
            b[k] = (rest << bits) // upper[k, k]
        for c in range(count):  # orthonormal again
            for _ in range(2):
                for earlier in range(c):
                    b[:, c] -= (b[:, earlier] * ((b[:, earlier] * b[:, c]).sum() >> bits)) >> bits
                length = math.isqrt(int((b[:, c] * b[:, c]).sum())) or 1
                b[:, c] = (b[:, c] << bits) // length
    return [[int(x) for x in b[:, c]] for c in range(count)]


def principal(spark: SparkSession, M: list[list[int]], most: int = COMPONENTS) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues of M and their unit vectors as rows of doubles, ``most`` at most."""
    q, simple = characteristic(spark, M)
    while len(q) > 1 and not q[0]:  # roots that are 0
        q = q[1:]
    values, rows = [], []
    for root, count in largest_roots(q, most, simple):
        for vector in _null_vectors(M, root, count, 3 * BITS):
            values.append(root)
            rows.append([float(Fraction(x, 1 << (3 * BITS))) for x in vector])
    return values[:most], np.array(rows[:most]).reshape(-1, len(M))


# -------------------------------------------------------------------------------------- whitening


def _projected(x: np.ndarray, n: int, sums: list[int], centre: list[int], components: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact, and the whitened coordinates."""
    top = int(abs(x - np.array(centre, np.int64)).max(initial=0)) + 1
    off = np.array([s - n * m for s, m in zip(sums, centre, strict=True)], object)
    moved = x - np.array(centre, np.int64)
    if n * (top + 1) < 1 << 62:
        far = moved * n - off.astype(np.int64)
    else:
        far = moved.astype(object) * n - off
    return far, (far.astype(np.float64) / n) @ components.T / scale


def _whiten(d: int, n: int, sums: list[int], centre: list[int], components: np.ndarray, scale: np.ndarray, explained: np.ndarray):
    from decimal import Decimal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(components)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            far, white = _projected(_integers(batch, d), n, sums, centre, components, scale)
            top = int(abs(far).max())
            if top * top * d < 1 << 63:
                deviation = pa.array((far * far).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                whole = [int(x) for x in (far.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([Decimal(x) if x < 10**38 else None for x in whole], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()), pa.array(np.full(len(each), n)),
                    deviation.take(each), pa.array(white.reshape(-1)), pa.array(np.tile(explained, batch.num_rows)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return run


def _white_sums(d: int, n: int, sums: list[int], centre: list[int], components: np.ndarray, scale: np.ndarray):
    """Sums of whitened coordinates (i = -1) and of their products, one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(components)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                white = _projected(_integers(batch, d), n, sums, centre, components, scale)[1]
                first += white.sum(axis=0)
                second += white.T @ white
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(k, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(k), j]), pa.int32()), pa.array(np.concatenate([first, second.reshape(-1)]))],
            ["i", "j", "total"],
        )

    return run


def whiten(embeddings: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component; deviation is
    an exact decimal, null from 10^38 on."""
    spark = embeddings.sparkSession
    rows, d = vectors_of(embeddings, column)
    n, sums, centre, M = scatter(rows, d)
    values, components = principal(spark, M, most) if n and d else ([], np.zeros((0, d)))
    trace = sum(M[i][i] for i in range(d))
    explained = np.array([float(e / trace) for e in values])
    scale = np.array([math.sqrt(e / (n * n)) for e in values])
    error = 0.0
    if values:
        k = len(values)
        found = rows.select("v").mapInArrow(_white_sums(d, n, sums, centre, components, scale), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
        held = {(r["i"], r["j"]): r["total"] / n for r in found}
        mean = np.array([held[-1, j] for j in range(k)])
        cov = np.array([[held[i, j] for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        error = float(abs(cov - np.eye(k)).max())
    white = rows.mapInArrow(_whiten(d, n, sums, centre, components, scale, explained), WHITE)
    return white.withColumn("identity_error", F.lit(error))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit a long; ``deviation_exact`` holds it then as well."""
    return whiten(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )
