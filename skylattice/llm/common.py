"""Shared helpers of the corpus operators: tables, durable stages, vectorised words.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a
multi-byte UTF-8 character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="skylattice-"))
        folder = _own_folder[0]
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and a lost
    executor costs only the tasks that were reading."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be broadcast.
MAX_BROADCAST = 1_000_000


def few(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df`` with a hint to broadcast it if it has no more than ``most`` rows; else a plain join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, members: str, heavy: int = 10_000) -> DataFrame:
    """Each of ``rows`` with the columns of its group (``key``, ``members``, ...); every key of ``rows`` has one row in ``groups``, which
    counts all its rows in ``members``. Groups of more than a ``heavy``-th of all rows, fewer than ``heavy`` by that, are broadcast, so
    that their rows stay where they are; no key that is shuffled has more rows than that. Both tables are read more than once."""
    total = groups.agg(F.sum(members)).first()[0] or 0
    large, small = (groups.filter(c).drop(members) for c in (F.col(members) * heavy > total, F.col(members) * heavy <= total))
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(small, key))


def words_column(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------------------------------- numpy


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BASE = 0x2545F4914F6CDD1D
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Powers are held up to this exponent; a higher one is that of a multiple times one of these.
_STEP = 1 << 17
_BYTE = _splitmix(256, 11)
_GRAM = _splitmix(64, 77) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``. Functions travel by value and so have globals for each
    task; the tables are held once for each Python process instead."""
    held = sys.modules.setdefault("_skylattice_process", types.ModuleType("_skylattice_process"))
    if len(getattr(held, "powers", [()])[0]) < n:
        held.powers = [np.full(-(-n // _STEP) * _STEP, base, np.uint64) for base in (_BASE, _UNBASE)]
        for steps in held.powers:
            steps[0] = 1
            np.cumprod(steps, out=steps)
    return held.powers


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed; most of their high bytes are alike."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(x[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets, in rising order for rising keys, of evenly spread 64-bit keys."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def spans_of(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    cuts = [0, *(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1), len(sorted_values)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


class Words:
    """Words of a slice of rows: ``row`` (index in the slice), byte ``start`` and ``end`` in
    ``data``, 64-bit ``code`` of the bytes."""

    def __init__(self, column: pa.Array, lower: bool = False, codes: bool = True) -> None:
        column = pc.fill_null(column, "")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, where, held = column.buffers()
        offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and len(offsets) else np.zeros(0, np.uint8)
        self.offsets, self.n_rows = offsets - offsets[0], len(column)
        self.data = data = _LOWER[data] if lower else data
        word = _IS_WORD[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]
        first[edges] |= word[edges]
        last[edges - 1] |= word[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        if codes:
            up, down = _power_tables(_STEP)
            far_up, far_down = (np.array([pow(x, _STEP * k, 1 << 64) for k in range(len(data) // _STEP + 1)], np.uint64) for x in (_BASE, _UNBASE))
            sums = np.zeros(len(data) + 1, np.uint64)
            for k, a in enumerate(range(0, len(data), _STEP)):
                piece = sums[1 + a : 1 + a + _STEP]
                np.multiply(_BYTE[data[a : a + _STEP]], up[: len(piece)] * far_up[k], out=piece)
            np.cumsum(sums[1:], out=sums[1:])
            self.code = mix((sums[self.end] - sums[self.start]) * (down[self.start % _STEP] * far_down[self.start // _STEP]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, 64-bit code) of each run of ``n`` words inside one row."""
        m = len(self.code) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        code = np.zeros(m, np.uint64)
        for j in range(n):
            code += self.code[j : j + m] * _GRAM[j]
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        return at, mix(code[at])


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most_bytes`` of text; no row is cut. A reused worker first drops what
    an earlier task's functions held, and gives Arrow's spare memory back at the end."""
    gc.collect()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
