"""Substring dedup: FM-indexes find word runs that occurred before; all but the first go.

A window is 20 consecutive words of one document. A window is a repeat if the same words also start
earlier (smaller doc_id, or the same document and an earlier start); words under a repeat are removed.

Sharding by content. Each window has a minimizer, the least code among its 6-word runs. Equal windows
have equal minimizers, so the minimizer decides the shard, and every window is looked up in one shard
only: the work grows with the text, not with text times shards. Neighbouring windows around one place of a
minimizer form a segment, which holds no window twice.

1. Texts are packed into chunks of about ``CHUNK_BYTES``. A chunk tells buckets its distinct minimizers and, in
   other buckets, its distinct segments (a 96-bit code) with their earliest places; both are one entry of a chunk
   however often they come. It learns which minimizers other segments have too and which segments start here first.
2. Segments whose minimizer comes once are done: their windows occur once. Of the others the chunk that has the earliest
   place sends the words to the minimizer's shard, so that equal segments are one entry there.
3. A shard builds a compressed FM-index of its entries and streams them through backward search over its wavelet
   matrix. The matching statistic of a word is how many words up to it occur elsewhere too; where it reaches the threshold
   of 20, the earliest place in the suffix interval tells if the window is a repeat. Intervals above the threshold go back
   to the chunks.
4. A chunk removes the words of these intervals, and later copies of an entry as a whole.

A minimizer with more than ``MAX_SEGMENTS`` segments would overload a shard. Its windows are entries of their own,
dealt to the same shards by the code of all their words. Where more than ``MAX_SAME`` chunks may hold one such window,
shards of groups of chunks sift them first, and only the earliest of a group goes on.

Defined cases: null, empty and short texts have no windows and lose nothing; rows of one doc_id count as
one document, so equal rows do not repeat each other; rows with a null doc_id are neither searched nor
found; an empty table gives no rows; other columns are not read. Words inside a shard are compared by 64-bit codes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, bucket_of, mix, packed, slices, spans_of, stage, table, unpacked
from .fm_index import FMIndex

WINDOW = 20
RUN = 6
MAX_SEGMENTS = 20_000
MAX_SAME = 4096
SHARD_WORDS = 500_000
CHUNK_BYTES = 2 << 20
#: Entries of a bucket, about, once there are more than ``LEAST_BUCKETS`` full ones.
BUCKET = 1_000_000
LEAST_BUCKETS = 32

ALONE, SEVERAL, HOT = 0, 1, 2
CHUNK = "chunk long, doc_ids array<long>, lengths array<long>, texts binary"
#: What a chunk is told: ``kind`` 0 states of minimizers, 1 whether segments start here first, 2 repeated intervals of entries.
NOTE = "chunk long, kind int, bucket long, body binary"
ENTRY = "shard long, chunk long, places binary, texts binary"


def _zipped(data) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unzipped(body: bytes, size: int) -> pa.Buffer:
    return pa.decompress(body, decompressed_size=size, codec="zstd") if size else pa.py_buffer(b"")


def _strings(data: pa.Buffer, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), data)


def texts_of(t: pa.RecordBatch | pa.Table, k: int) -> tuple[pa.Array, pa.Array]:
    """doc_ids and texts of a chunk."""
    lengths = t.column("lengths")[k].values.to_numpy(zero_copy_only=False)
    return t.column("doc_ids")[k].values, _strings(_unzipped(t.column("texts")[k].as_py(), int(lengths.sum())), lengths)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def run_codes(code: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Code of the ``length`` words from word ``first``."""
    up, down = common._power_tables(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[: len(code)], out=sums[1:])
    return mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64))


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of first[i], first[i] + 1, ... with n[i] values each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]


class Groups:
    """Equal runs of words: ``group`` of each, and ``lead``, the run of each group with the least (doc, start). Groups are
    in the order of their codes; ``code`` and ``check`` have 96 bits together."""

    def __init__(self, words: Words, other: np.ndarray, at: np.ndarray, length: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        code, check = run_codes(words.code, at, length), run_codes(other, at, length) >> np.uint64(32)
        order = np.lexsort((start, doc, check, code))
        new = np.ones(len(order), bool)
        new[1:] = (code[order[1:]] != code[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.lead = order[new]
        self.code, self.check = code[self.lead], check[self.lead]
        lead = self.lead[self.group]
        self.first = (doc == doc[lead]) & (start == start[lead])


class Chunk:
    """A chunk's words and segments: word ``at``, ``n`` windows, ``doc`` and ``start`` of each; rows without doc_id have none.
    ``minis`` are the distinct minimizers, 48 bits in the upper part, and ``mini`` is the one of each group of equal segments."""

    def __init__(self, t: pa.RecordBatch | pa.Table, k: int) -> None:
        doc_ids, texts = texts_of(t, k)
        self.doc_ids, self.chunk = doc_ids, t.column("chunk")[k].as_py()
        self.words = words = Words(texts)
        known, doc = pc.is_valid(doc_ids).to_numpy(zero_copy_only=False), pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        self.begins = np.searchsorted(words.row, np.arange(words.n_rows + 1))
        n = max(0, len(words.code) - WINDOW + 1)
        runs = np.zeros(max(0, len(words.code) - RUN + 1), np.uint64)
        for j in range(RUN):
            runs += words.code[j : j + len(runs)] * common._GRAM[j]
        runs = mix(runs)
        at = np.flatnonzero((words.row[:n] == words.row[len(words.row) - n :]) & known[words.row[:n]])
        least = _sliding_min(runs, WINDOW - RUN + 1)[at] if n else runs[:0]
        new = np.ones(len(at), bool)
        # A segment also ends where its minimizer leaves the window, so that no window is in it twice.
        left = runs[at[:-1]] == least[:-1]
        new[1:] = (least[1:] != least[:-1]) | left | (np.diff(at) != 1) | (words.row[at[1:]] != words.row[at[:-1]])
        first = np.flatnonzero(new)
        self.n = np.diff(np.append(first, len(at)))
        self.at = at[first]
        row = words.row[self.at]
        self.doc, self.start = doc[row], self.at - self.begins[row]
        self.other = mix(words.code + np.uint64(0x9E3779B97F4A7C15))
        self.groups = Groups(words, self.other, self.at, self.n + WINDOW - 1, self.doc, self.start)
        whole = least[first][self.groups.lead] & np.uint64(0xFFFFFFFFFFFF0000)
        self.minis, self.mini = np.unique(whole, return_inverse=True)

    def told(self, notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """State of each minimizer, and of each group whether this chunk has its earliest place."""
        notes = notes.sort_by("bucket")
        kind, body = notes.column("kind").to_numpy(), notes.column("body")
        states, own = (np.concatenate([np.zeros(0, np.int64), *(unpacked(body[int(i)].as_py()) for i in np.flatnonzero(kind == k))]) for k in (0, 1))
        return states, own.astype(bool)

    def hot_windows(self, states: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Groups]:
        """Word, doc and start of each window under hot minimizers, in segments that start here first, and their groups."""
        g = self.groups
        held = np.flatnonzero(own[g.group] & (states[self.mini[g.group]] == HOT) & g.first)
        which, at = _expanded(self.at[held], self.n[held])
        doc, start = self.doc[held][which], at - self.at[held][which] + self.start[held][which]
        return at, doc, start, Groups(self.words, self.other, at, np.full(len(at), WINDOW), doc, start)


def chunks_of(most_bytes: int):
    """Documents (doc_id, text) to chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for made, part in enumerate(slices(batches, "text", most_bytes)):
            text = pc.fill_null(part.column("text"), "").cast(pa.large_string())
            _, where, held = text.buffers()
            offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].tobytes() if held else b""
            lists = [pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), x) for x in (part.column("doc_id"), pa.array(np.diff(offsets)))]
            yield pa.RecordBatch.from_arrays([pa.array([task + made]), *lists, pa.array([_zipped(data)], pa.binary())], ["chunk", "doc_ids", "lengths", "texts"])

    return run


def _asked(buckets: int):
    """Distinct minimizers with the segments and groups that have them; distinct segments with their earliest places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        for batch in batches:
            for k in range(batch.num_rows):
                c = Chunk(batch, k)
                g, size = c.groups, np.bincount(c.groups.group, minlength=len(c.groups.lead))
                counts = [np.bincount(c.mini, minlength=len(c.minis)), np.bincount(c.mini, weights=size, minlength=len(c.minis)).astype(np.int64)]
                out: dict[str, list] = {"kind": [], "bucket": [], "chunk": [], "keys": [], "more": []}
                for kind, keys, more in ((0, c.minis, counts), (1, g.code, [g.check.view(np.int64), c.doc[g.lead], c.start[g.lead]])):
                    bucket, shown = bucket_of(keys, buckets), keys >> np.uint64(16) if kind == 0 else keys
                    for a, b in spans_of(bucket):
                        out["kind"].append(kind), out["bucket"].append(int(bucket[a])), out["chunk"].append(c.chunk)
                        out["keys"].append(packed(np.diff(shown[a:b], prepend=np.uint64(0))))
                        out["more"].append(packed(np.concatenate([x[a:b] for x in more])))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())]))
        pa.default_memory_pool().release_unused()

    return run


def _answered(max_segments: int):
    """One bucket to its chunks: states of minimizers, or who has a segment's earliest place. ``entries`` is given once: how
    many segments have a minimizer that comes again, equal ones of several chunks counted for each."""

    def run(t: pa.Table) -> pa.Table:
        held = [np.cumsum(unpacked(x).view(np.uint64)) for x in t.column("keys").to_pylist()]
        ends, keys, kind = np.cumsum([len(x) for x in held]), np.concatenate(held), t.column("kind")[0].as_py()
        entries = np.zeros(t.num_rows, np.int64)
        more = np.concatenate([unpacked(x).reshape(2 if kind == 0 else 3, -1) for x in t.column("more").to_pylist()], axis=1)
        if kind == 0:
            known, at = np.unique(keys, return_inverse=True)
            groups, segments = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            np.add.at(groups, at, more[0]), np.add.at(segments, at, more[1])
            state = np.where(segments < 2, ALONE, np.where(groups > max_segments, HOT, SEVERAL))
            entries[0], answer = int(groups[state != ALONE].sum()), state[at]
        else:
            check, doc, start = more
            order = np.lexsort((start, doc, check, keys))
            new = np.ones(len(order), bool)
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            lead = order[new][np.cumsum(new) - 1]
            answer = np.zeros(len(keys), np.int64)
            answer[order] = (doc[order] == doc[lead]) & (start[order] == start[lead])
        bodies = [packed(np.ascontiguousarray(x)) for x in np.split(answer, ends[:-1])]
        return pa.Table.from_arrays([t.column("chunk"), t.column("kind"), t.column("bucket"), pa.array(bodies, pa.binary()), pa.array(entries)], ["chunk", "kind", "bucket", "body", "entries"])

    return run


def _entries(n_shards: int):
    """What a chunk sends to the shards: segments that start here first, numbered from 0, and windows under hot minimizers,
    numbered down from -1; their places and words."""

    def run(chunk: pa.Table, notes: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "chunk": [], "places": [], "texts": []}
        for k in range(chunk.num_rows):
            c = Chunk(chunk, k)
            states, own = c.told(notes)
            sent = np.flatnonzero(own & (states[c.mini] == SEVERAL))
            lead = c.groups.lead[sent]
            at, doc, start, windows = c.hot_windows(states, own)
            hot = windows.lead
            key = np.concatenate([mix(c.minis[c.mini[sent]]), mix(windows.code)])
            number = np.concatenate([sent, -1 - np.arange(len(hot))])
            place = [np.concatenate(x) for x in ((c.doc[lead], doc[hot]), (c.start[lead], start[hot]))]
            first = np.concatenate([c.at[lead], at[hot]])
            last = first + np.concatenate([c.n[lead] + WINDOW - 2, np.full(len(hot), WINDOW - 1)])
            a, b = c.words.start[first], c.words.end[last]
            shard = (key % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            data = c.words.data.tobytes()
            for i, j in spans_of(shard[order]):
                of = order[i:j]
                out["shard"].append(int(shard[of[0]])), out["chunk"].append(c.chunk)
                out["places"].append(packed(np.concatenate([number[of], place[0][of], place[1][of], (b - a)[of]])))
                out["texts"].append(_zipped(b"".join([data[x:y] for x, y in zip(a[of].tolist(), b[of].tolist(), strict=True)])))
        return pa.Table.from_pydict(out, pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("places", pa.binary()), ("texts", pa.binary())]))

    return run


def repeats_in_shard(doc_id: np.ndarray, start: np.ndarray, segments: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the segment, first word, word after the last) of the runs of repeated windows, by an
    FM-index of the segments through which they are streamed; words are counted from the start of the segment."""
    size = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(size + 1) - size - 1
    symbols = np.ones(int(size.sum()) + len(size), np.int64)  # 1 ends a segment
    inside = np.ones(len(symbols), bool)
    inside[begins + size] = False
    symbols[inside] = np.unique(np.concatenate(segments), return_inverse=True)[1] + 2
    index = FMIndex(symbols)
    segment = np.repeat(np.arange(len(size)), size + 1)
    order = np.unique(doc_id, return_inverse=True)[1].astype(np.int64)
    place = (order[segment] << 40) + start[segment] + np.arange(len(symbols)) - begins[segment]
    of, at = _expanded(begins, size - window + 1)
    length, low, high = index.matching_statistics(at + window - 1, window)
    many = np.flatnonzero(length == window)
    earliest = index.earliest(low[many], high[many], np.append(place, np.iinfo(np.int64).max))
    hit = many[earliest < place[at[many]]]
    if not len(hit):
        return hit, hit, hit
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    which = of[hit[first]]
    word = at[hit[first]] - begins[which]
    return which, word, word + (at[hit[last]] - at[hit[first]]) + window


def _search(t: pa.Table) -> tuple[dict[int, np.ndarray], np.ndarray, list[np.ndarray]]:
    """One shard: intervals (number, first, end) by chunk, whether each entry has a repeat, and places by row of ``t``."""
    places = [unpacked(x).reshape(4, -1) for x in t.column("places").to_pylist()]
    number, doc, start, length = np.concatenate(places, axis=1)
    text = b"".join(_unzipped(x, int(p[3].sum())).to_pybytes() for x, p in zip(t.column("texts").to_pylist(), places, strict=True))
    words = Words(_strings(pa.py_buffer(text), length))
    cuts = np.searchsorted(words.row, np.arange(len(length) + 1))
    which, first, end = repeats_in_shard(doc, start, np.split(words.code, cuts[1:-1]))
    chunk = np.repeat(t.column("chunk").to_numpy(), [p.shape[1] for p in places])
    order = np.argsort(chunk[which], kind="stable")
    found = {}
    for a, b in spans_of(chunk[which][order]):
        of = order[a:b]
        found[int(chunk[which[of[0]]])] = np.concatenate([number[which[of]], first[of], end[of]])
    repeated = np.zeros(len(length), bool)
    repeated[which] = True
    return found, repeated, places


def _searched(t: pa.Table) -> pa.Table:
    found, _, _ = _search(t)
    n, shard = len(found), t.column("shard")[0].as_py()
    return pa.Table.from_arrays(
        [pa.array(list(found), pa.int64()), pa.array([2] * n, pa.int32()), pa.array([shard] * n, pa.int64()), pa.array([packed(x) for x in found.values()], pa.binary())],
        ["chunk", "kind", "bucket", "body"],
    )


def _sifted(t: pa.Table) -> pa.Table:
    """A group of chunks in a shard: intervals (with shard -1), and the entries that go on: all segments, and the windows that
    no other of the group comes before."""
    found, repeated, places = _search(t)
    out: dict[str, list] = {"shard": [-1] * len(found), "chunk": list(found), "places": [packed(x) for x in found.values()], "texts": [None] * len(found)}
    at = 0
    for shard, chunk, place, text in zip(t.column("shard").to_pylist(), t.column("chunk").to_pylist(), places, t.column("texts").to_pylist(), strict=True):
        stay = ~repeated[at : at + place.shape[1]] | (place[0] >= 0)
        at += place.shape[1]
        if stay.any():
            body, ends = _unzipped(text, int(place[3].sum())).to_pybytes(), np.cumsum(place[3])
            kept = b"".join(body[e - k : e] for e, k in zip(ends[stay].tolist(), place[3][stay].tolist(), strict=True))
            out["shard"].append(shard), out["chunk"].append(chunk), out["places"].append(packed(place[:, stay].reshape(-1))), out["texts"].append(_zipped(kept))
    return pa.Table.from_pydict(out, pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("places", pa.binary()), ("texts", pa.binary())]))


def _removed(c: Chunk, notes: pa.Table) -> np.ndarray:
    """Whether each word of a chunk is under a repeated window."""
    states, own = c.told(notes)
    g = c.groups
    at, _, _, windows = c.hot_windows(states, own)
    later = np.flatnonzero(~(own[g.group] & g.first))
    spans = [(c.at[later], c.at[later] + c.n[later] + WINDOW - 1), (at[~windows.first], at[~windows.first] + WINDOW)]
    bodies = notes.filter(pc.equal(notes.column("kind"), 2)).column("body").to_pylist()
    number, first, end = np.concatenate([np.zeros((3, 0), np.int64), *(unpacked(x).reshape(3, -1) for x in bodies)], axis=1)
    for held, group, word in (((number >= 0), g, c.at), ((number < 0), windows, at)):
        # An interval of an entry holds for each segment at the entry's own place (rows of one doc_id may be equal).
        places = np.flatnonzero(group.first)
        places = places[np.argsort(group.group[places], kind="stable")]
        entry = np.where(number[held] >= 0, number[held], -1 - number[held])
        a, b = (np.searchsorted(group.group[places], entry, side=x) for x in ("left", "right"))
        which, index = _expanded(a, b - a)
        spans.append((word[places[index]] + first[held][which], word[places[index]] + end[held][which]))
    change = np.zeros(len(c.words.row) + 1, np.int64)
    for a, b in spans:
        np.add.at(change, a, 1), np.add.at(change, b, -1)
    return np.cumsum(change)[:-1] > 0


def _kept(chunk: pa.Table, notes: pa.Table) -> pa.Table:
    tables = []
    for k in range(chunk.num_rows):
        c = Chunk(chunk, k)
        words, keep = c.words, ~_removed(c, notes)
        size = words.end[keep] - words.start[keep] + 1
        at = np.cumsum(size) - size
        data = np.append(words.data, np.uint8(0x20))
        out = data[np.arange(size.sum()) - np.repeat(at - words.start[keep], size)]
        out[at + size - 1] = 0x20
        # No space after a document's last word.
        n_kept = np.bincount(words.row[keep], minlength=words.n_rows)
        some = n_kept > 0
        last = np.cumsum(n_kept)[some] - 1
        stay = np.ones(len(out), bool)
        stay[at[last] + size[last] - 1] = False
        length = np.bincount(words.row[keep], weights=size, minlength=words.n_rows).astype(np.int64) - some
        n_words = np.bincount(words.row, minlength=words.n_rows)
        text = _strings(pa.py_buffer(out[stay].tobytes()), length).cast(pa.string())
        tables.append(pa.Table.from_arrays([c.doc_ids, text, pa.array(n_words), pa.array(n_words - n_kept)], ["doc_id", "text", "n_words", "n_removed"]))
    return pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64())})


def deduplicate(
    docs: DataFrame, shard_words: int = SHARD_WORDS, max_segments: int = MAX_SEGMENTS, max_same: int = MAX_SAME, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each row with the words that stay, joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stage(docs.mapInArrow(chunks_of(chunk_bytes), CHUNK), "chunks")
    n_chunks, n_bytes = chunks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, n_bytes // (40 * BUCKET))
    asked = chunks.mapInArrow(_asked(buckets), "kind int, bucket long, chunk long, keys binary, more binary")
    answers = stage(asked.groupBy("kind", "bucket").applyInArrow(_answered(max_segments), f"{NOTE}, entries long"), "answers")
    total = answers.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    n_shards = total * (WINDOW + RUN) // shard_words + 1
    answers = answers.drop("entries")
    entries = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_entries(n_shards), ENTRY)
    notes, same = answers, n_chunks
    while same > max_same:
        same = -(-same // max_same)
        sifted = stage(entries.groupBy("shard", F.pmod(F.xxhash64("chunk"), F.lit(same)).alias("part")).applyInArrow(_sifted, ENTRY), "sifted")
        notes = notes.union(sifted.filter("shard < 0").select("chunk", F.lit(2).alias("kind"), "shard", F.col("places").alias("body")))
        entries = sifted.filter("shard >= 0")
    notes = notes.union(entries.groupBy("shard").applyInArrow(_searched, NOTE))
    return chunks.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM d),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS k, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i+19], ' ')))) AS g FROM d WHERE len(ws) >= 20),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1 AS again FROM s),
m AS (SELECT w.doc_id, w.k, w.word, coalesce(max(r.again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.k = r.k)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(x.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(x.body, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY k) AS body FROM m GROUP BY doc_id) x
  ON d.doc_id = x.doc_id
"""
