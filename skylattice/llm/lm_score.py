"""LM scoring: cross-entropy difference of matched bigram models.

Two models, of the target documents and of all documents (the background), share one vocabulary (all words
of the corpus and one unknown word) and one smoothing, so that their losses differ only by what the texts hold:

    P(w | v) = 0.7 c(v, w) / c(v) + 0.25 c(w) / N + 0.05 / V

and the first term's share goes to the others where v was never seen. A document's score is the mean
over its words of -ln P_target(w | v) + ln P_background(w | v): below 0, it is nearer to the target.

Counts cover every word and every pair of words of every document, and grow with the corpus; none passes through
the driver, and no word is left out. Documents are packed into chunks of about ``FLUSH`` words. A chunk sends its
distinct pairs and words once each, with what it counts of them, to buckets by 64-bit code; a word carries how often
it comes and how often a word follows it. A bucket adds up the chunks' counts and sends each chunk what the other
chunks add to its own (nothing, for most), with which the chunk's documents are scored. So a hot word or pair is one
entry of a chunk, however many documents hold it.

Defined cases: a null or blank text has no words and a null score; without target documents the target
model is uniform; repeated rows count as often as they come and each get a row; a null doc_id is
background only; several labels of one document count as its best; other columns are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bucket_of, few, mix, packed, slices, spans_of, stage, table, unpacked

WEIGHTS = (0.7, 0.25, 0.05)
#: Words of a chunk, about; a document is never cut.
FLUSH = 1_000_000
MAX_ROWS = 100_000
#: Entries that a bucket gets from all chunks, about, once there are more than ``LEAST_BUCKETS`` full ones.
BUCKET = 2_000_000
LEAST_BUCKETS = 256

CHUNK = "chunk long, doc_ids array<long>, n_words array<long>, targets array<boolean>, words long, target_words long, codes binary, ids binary"


def _chunks(most_words: int):
    """Documents (doc_id, text, target) to chunks: codes of the chunk's distinct words by falling count, and the words as
    indices of them, so that most indices are small and pack well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        doc_ids, targets, lengths, held = [], [], [], []

        def chunk() -> pa.RecordBatch:
            codes, ids, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            codes, ids = codes[order], np.argsort(order)[ids]
            n, target = np.concatenate(lengths), pa.concat_arrays(targets)
            in_target = int(n[target.to_numpy(zero_copy_only=False)].sum())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x) for x in (pa.concat_arrays(doc_ids), pa.array(n), target)]
            rest = [pa.array([x], pa.int64()) for x in (len(ids), in_target)] + [pa.array([packed(x)], pa.binary()) for x in (codes, ids.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *lists, *rest], ["chunk", "doc_ids", "n_words", "targets", "words", "target_words", "codes", "ids"])

        for part in slices(batches, "text"):
            words = Words(part.column("text"), lower=True)
            held.append(words.code)
            lengths.append(np.bincount(words.row, minlength=words.n_rows))
            doc_ids.append(part.column("doc_id").cast(pa.int64())), targets.append(part.column("target"))
            if sum(map(len, held)) >= most_words or sum(map(len, lengths)) >= MAX_ROWS:
                yield chunk()
                made += 1
                doc_ids, targets, lengths, held = [], [], [], []
        if lengths:
            yield chunk()

    return run


class Entries:
    """What a chunk counts: distinct pairs and words. ``keys`` are their codes in rising order, odd for words; ``place`` is
    where the pairs, then the words, are in them; the last word stands before the first of each document. ``pair`` is the
    pair of each word, ``left`` and ``right`` are the pairs' context and word."""

    def __init__(self, codes: bytes, ids: bytes, n: np.ndarray) -> None:
        code, self.ids = unpacked(codes).view(np.uint64), unpacked(ids)
        self.size = size = len(code)
        self.before = np.empty(len(self.ids), np.int64)
        self.before[1:] = self.ids[:-1]
        self.before[(np.cumsum(n) - n)[n > 0]] = size
        pairs, self.pair = np.unique(self.before * max(size, 1) + self.ids, return_inverse=True)
        self.left, self.right = np.divmod(pairs, max(size, 1))
        word = mix(np.append(code, np.uint64(1)) + np.uint64(0x9E3779B97F4A7C15))
        pair = mix(word[self.left] * np.uint64(0xD1342543DE82EF95) + code[self.right])
        keys = np.concatenate([pair & np.uint64(0xFFFFFFFFFFFFFFFE), word | np.uint64(1)])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def counts(self, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        """By key, over the words that ``chosen`` marks: how often it comes, and how often it is a context."""
        p, n = len(self.left), self.size + 1
        out = np.zeros((2, len(self.keys)), np.int64)
        out[0, self.place] = np.concatenate([np.bincount(self.pair[chosen], minlength=p), np.bincount(self.ids[chosen], minlength=n)])
        out[1, self.place[p:]] = np.bincount(self.before[chosen], minlength=n)
        return out


def _opened(t: pa.RecordBatch | pa.Table, k: int) -> tuple[Entries, np.ndarray]:
    n = np.array(t.column("n_words")[k].as_py(), np.int64)
    return Entries(t.column("codes")[k].as_py(), t.column("ids")[k].as_py(), n), n


def _all_counts(e: Entries, target, n: np.ndarray) -> np.ndarray:
    """Counts of all documents, then of the target's."""
    return np.concatenate([e.counts(), e.counts(np.repeat(np.array(target.as_py(), bool), n))])


def _asked(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in batches:
            for k in range(batch.num_rows):
                e, n = _opened(batch, k)
                counts = _all_counts(e, batch.column("targets")[k], n)
                bucket = bucket_of(e.keys, buckets)
                spans = spans_of(bucket)
                keys = [packed(np.diff(e.keys[a:b], prepend=np.uint64(0))) for a, b in spans]
                bodies = [packed(counts[:, a:b].reshape(-1)) for a, b in spans]
                first = bucket[[a for a, _ in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), batch.column("chunk")[k].as_py())), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["bucket", "chunk", "keys", "counts"])
        pa.default_memory_pool().release_unused()

    return run


def _answered(t: pa.Table) -> pa.Table:
    """One bucket: to each chunk what the other chunks add to its counts, and once how many words the bucket has."""
    held = [np.cumsum(unpacked(x).view(np.uint64)) for x in t.column("keys").to_pylist()]
    counts = np.concatenate([unpacked(x).reshape(4, -1) for x in t.column("counts").to_pylist()], axis=1)
    known, at = np.unique(np.concatenate(held), return_inverse=True)
    sums = np.zeros((4, len(known)), np.int64)
    for k in range(4):
        np.add.at(sums[k], at, counts[k])
    ends = np.cumsum([len(x) for x in held])
    others = np.split(sums[:, at] - counts, ends[:-1], axis=1)
    words = np.zeros(t.num_rows, np.int64)
    words[0] = int(((known & np.uint64(1) > 0) & (sums[0] > 0)).sum())  # the start of documents is no word
    return pa.Table.from_arrays([t.column("chunk"), t.column("bucket"), pa.array(words), pa.array([packed(x.reshape(-1)) for x in others], pa.binary())], ["chunk", "bucket", "words", "counts"])


def losses(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: int, size: int, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """-ln P(w | v) from c(v, w), c(w) and c(v) of each pair, ``n`` words in all and ``size`` symbols."""
    rest = np.full(len(pair), 1.0 / size)
    if n:
        share = weights[1] / (weights[1] + weights[2])
        rest = share * word / n + (1 - share) / size
    return -np.log(np.where(context > 0, weights[0] * pair / np.maximum(context, 1) + (1 - weights[0]) * rest, rest))


def _scores(totals: tuple[int, int], size: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        e, n = _opened(chunk, 0)
        answers = answers.sort_by("bucket")
        row, some, empty = np.repeat(np.arange(len(n)), n), np.maximum(n, 1), n == 0
        others = np.concatenate([np.zeros((4, 0), np.int64), *(unpacked(x).reshape(4, -1) for x in answers.column("counts").to_pylist())], axis=1)
        sums = (_all_counts(e, chunk.column("targets")[0], n) + others)[:, e.place]
        h = []
        for (count, context), total in zip((sums[2:], sums[:2]), totals, strict=True):
            pair, word = count[: len(e.left)], count[len(e.left) :]
            loss = losses(pair, word[e.right], context[len(e.left) :][e.left], total, size)
            h.append(np.bincount(row, weights=loss[e.pair], minlength=len(n)) / some)
        return pa.Table.from_arrays(
            [chunk.column("doc_ids").combine_chunks().flatten(), pa.array(n), *(pa.array(x, mask=empty) for x in (h[0], h[1], h[0] - h[1]))],
            ["doc_id", "n_words", "target_loss", "background_loss", "score"],
        )

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, chunk_words: int = FLUSH) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of each row of ``docs`` (doc_id, text);
    ``target`` has the doc_id of the documents of the target."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = stage(target.select(F.col("doc_id").alias("target_id")).distinct(), "target")
    marked = docs.join(few(chosen), F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    chunks = stage(marked.mapInArrow(_chunks(chunk_words), CHUNK), "chunks")
    n, n_target = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("target_words"), F.lit(0))).first()
    buckets = max(min(LEAST_BUCKETS, 1 + n // 1000), n // BUCKET)
    asked = chunks.select("chunk", "n_words", "targets", "codes", "ids").mapInArrow(_asked(buckets), "bucket long, chunk long, keys binary, counts binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_answered, "chunk long, bucket long, words long, counts binary"), "answers")
    size = 1 + answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return chunks.drop("words", "target_words").groupBy("chunk").cogroup(answers.drop("words").groupBy("chunk")).applyInArrow(
        _scores((n_target, n), size), "doc_id long, n_words long, target_loss double, background_loss double, score double"
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.struct("quality", -F.col("toxic"))).alias("best")).filter("best.quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
