"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

Cuts are drawn in code points and text is cut in bytes. Both are converted by an index of the exceptions only: for every
multibyte character of a slice of texts its position and the bytes it takes beyond one, summed from the left. A code point's
byte is its number plus the excess before it, found by ``searchsorted``; where a slice is ASCII the index is empty and both
are the same number. All cuts of a slice are converted at once.

Draws are four 32-bit words of the SHA-256 of ``seed:doc_id``: two cuts, the form, the order. A text stays ``plain`` if it
is empty, holds a sentinel, or is drawn to; ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each part
behind its sentinel. ``restore`` rebuilds a text from its output and form alone.

Nothing is shuffled; a task holds one slice of texts (1 MB, or one longer text).

Defined cases: a null text is empty, so plain; a null doc_id draws as the word ``null``; repeated rows get the same cuts; a
text of one character has cuts 0 or 1; parts may be empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SEED = "1"
#: Percentages: texts that are cut, and among them those in the order suffix, prefix, middle.
CUT, SPM = 90, 20
#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of texts, null ones empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


class CodePoints:
    """The multibyte characters of some bytes of UTF-8: their byte positions, their numbers, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray) -> None:
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.number = self.byte - self.excess[:-1]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.number, points)]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the characters that begin at ``at``."""
        return at - self.excess[np.searchsorted(self.byte, at)]


def _check(sentinels: tuple[str, str, str]) -> None:
    """A first character that no sentinel holds elsewhere: then none can begin in one part and end in another."""
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in "".join(x[1:] for x in sentinels) for s in sentinels):
        raise ValueError("sentinels must differ, and their first characters must occur nowhere else in them")


def _transform(cut: int, spm: int, sentinels: tuple[str, str, str]):
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, data = _texts(batch.column("text"))
            index = CodePoints(data)
            first = index.to_points(offsets)
            n = np.diff(first)
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy().astype(np.int64) for k in (1, 2, 3, 4))
            x, y = h1 % (n + 1), h2 % (n + 1)
            x, y = np.minimum(x, y), np.maximum(x, y)
            at_x, at_y = index.to_bytes(first[:-1] + x), index.to_bytes(first[:-1] + y)
            held = np.zeros(len(n), bool)
            for mark in sentinels:
                held |= pc.fill_null(pc.match_substring(batch.column("text"), mark), False).to_numpy(zero_copy_only=False)
            plain = (n == 0) | held | (h3 % 100 >= cut)
            suffix_first = ~plain & (h4 % 100 < spm)
            view, out = memoryview(data), []
            for keep, turn, a, i, j, b in zip(plain.tolist(), suffix_first.tolist(), offsets[:-1].tolist(), at_x.tolist(), at_y.tolist(), offsets[1:].tolist(), strict=True):
                if keep:
                    out.append(bytes(view[a:b]))
                elif turn:
                    out.append(b"".join((s, view[j:b], p, view[a:i], m, view[i:j])))
                else:
                    out.append(b"".join((p, view[a:i], s, view[j:b], m, view[i:j])))
            form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(x, mask=plain), pa.array(y - x, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, cut: int = CUT, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text); n and the parts count
    code points, the parts are null for plain texts."""
    _check(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(_transform(cut, spm, sentinels), MADE)


def _restore(sentinels: tuple[str, str, str]):
    p, s, m = sentinels
    size = {k: len(k.encode()) for k in sentinels}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            offsets, data = _texts(batch.column("output"))
            at = {k: offsets[:-1] + pc.fill_null(pc.find_substring(batch.column("output"), k), -1).to_numpy(zero_copy_only=False) for k in sentinels}
            form = pc.fill_null(batch.column("form"), "plain").to_pylist()
            view, out = memoryview(data), []
            for i, (how, a, b) in enumerate(zip(form, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if how == "plain":
                    out.append(bytes(view[a:b]))
                    continue
                one, two = (p, s) if how == "psm" else (s, p)
                cuts = [(a + size[one], at[two][i]), (at[two][i] + size[two], at[m][i])]
                before, after = cuts if how == "psm" else cuts[::-1]
                out.append(b"".join((view[before[0] : before[1]], view[at[m][i] + size[m] : b], view[after[0] : after[1]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return run


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` (output, form and what else it has) with ``restored``, the text before the transformation."""
    _check(sentinels)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(_restore(sentinels), f"{schema}, restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(fill_in_middle(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t
), c AS (
  SELECT *, least(h1, h2) AS x, greatest(h1, h2) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1, n - y) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
