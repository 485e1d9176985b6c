"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent pairs of symbols whose concatenation is a piece, best score first and leftmost among
equals; the pair on top is merged and pairs with its neighbours join the agenda. Symbols that are left and no piece are
spelled in byte pieces. The agendas of short parts lie side by side in arrays, and each round takes the top of every one; a
long part's is a heap, where pairs whose symbols have changed meanwhile are passed over.

Two neighbouring characters that stand side by side in no piece can't be merged across, so a text is cut there first. The
cuts come from the vocabulary: around characters that no piece joins to another, and before a space symbol that follows
anything else, if no piece has one inside. The parts are mostly words; equal parts of a slice are merged once.

The vocabulary is a parameter, a file read on the driver and sent to the tasks (half a megabyte); every batch can be checked
against the ``sentencepiece`` library, which gives the column ``agrees``. A task holds one slice of texts (1 MB, or one longer
text). Nothing is shuffled.

Defined cases: a null text is empty and has no ids; null ids decode to the empty text, null entries are left out; an id outside
the vocabulary is an error; repeated rows get the same ids; an empty table gives no rows; columns other than those named are
not read, and ``decode`` keeps them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table

SPACE_SYMBOL = "▁"
#: Longest part whose agenda is in arrays.
SIDE_BY_SIDE = 40
_SPREAD, _NONE = 0x9E3779B97F4A7C15, np.int64(1) << np.int64(62)
#: Fixed values of the vocabulary file's format: piece types, model type, field numbers.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer: integers, or bytes for the rest."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, model: bytes) -> None:
        self.names, self.kinds, scores, trainer, normalizer = [], [], [], {}, {}
        for field, value in _fields(model):
            if field == PIECES:
                piece = dict(_fields(value))
                self.names.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_TYPE) != MERGES or not trainer.get(BYTE_FALLBACK) or trainer.get(SUFFIX_SPACE):
            raise ValueError("not a merge-type vocabulary with byte pieces and spaces in front")
        if normalizer.get(CHARACTER_MAP) or not normalizer.get(ESCAPE_SPACES, 1) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("character maps, plain spaces, own and unused pieces are not handled")
        self.prefix, self.squeeze = bool(normalizer.get(DUMMY_PREFIX, 1)), bool(normalizer.get(REMOVE_SPACES, 1))
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        self.cost = {n: -scores[i] for n, i in self.ids.items()}
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self._tables_to_encode()
        self._tables_to_decode(trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 "))

    def _tables_to_encode(self) -> None:
        self.size = len(self.names)
        places = {cost: place for place, cost in enumerate(sorted(set(self.cost.values())))}
        self.order = np.zeros(self.size, np.int64)
        for n, i in self.ids.items():
            self.order[i] = places[self.cost[n]]
        # By character: its piece or -1, and whether a longer piece holds it.
        self.symbol, self.joins = np.full(0x110000, -1, np.int32), np.zeros(0x110000, bool)
        for n, i in self.ids.items():
            if len(n) == 1:
                self.symbol[ord(n)] = i
            else:
                self.joins[[ord(c) for c in n]] = True
        self.cut_at_spaces = not any(SPACE_SYMBOL in n.lstrip(SPACE_SYMBOL) for n in self.ids)
        # Pairs of pieces that give a piece, in a table with open addresses.
        pairs = {self.ids[a] * self.size + self.ids[b]: i for n, i in self.ids.items() for k in range(1, len(n)) if (a := n[:k]) in self.ids and (b := n[k:]) in self.ids}
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for key, made in pairs.items():
            at = ((key * _SPREAD) & ((1 << 64) - 1)) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.made[at] = key, made

    def _tables_to_decode(self, unknown: bytes) -> None:
        surface = [
            b"" if k == CONTROL else unknown if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE_SYMBOL, " ").encode()
            for n, k in zip(self.names, self.kinds, strict=True)
        ]
        self.surface = surface
        self.length = np.array([len(x) for x in surface], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(surface), np.uint8)
        spaces = [len(n) - len(n.lstrip(SPACE_SYMBOL)) if k == NORMAL else 0 for n, k in zip(self.names, self.kinds, strict=True)]
        #: Bytes that go where the piece comes first: the space that encoding puts there.
        self.lead = np.array([x if self.squeeze else min(x, 1) for x in spaces] if self.prefix or self.squeeze else [0] * len(spaces), np.int64)
        #: Pieces that can spoil the characters of a row: controls end a run of bytes, bytes may spell none.
        self.careful = np.array([k == CONTROL or k == BYTE and int(n[3:5], 16) > 127 for n, k in zip(self.names, self.kinds, strict=True)])

    # -------------------------------------------------------------------------------- encoding

    def normalized(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE_SYMBOL)

    def _merge(self, text: str) -> list[int]:
        """The ids of one part, its agenda in a heap."""
        symbols: list[str | None] = list(text)
        cost, last = self.cost, len(symbols)
        left, right = list(range(-1, last - 1)), list(range(1, last + 1))
        agenda = [(cost[pair], i, i + 1, pair) for i in range(last - 1) if (pair := text[i : i + 2]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or len(a) + len(b) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = after = right[j]
            if after < last:
                left[after] = i
                if (new := pair + symbols[after]) in cost:
                    heapq.heappush(agenda, (cost[new], i, after, new))
            before = left[i]
            if before >= 0 and (new := symbols[before] + pair) in cost:
                heapq.heappush(agenda, (cost[new], before, i, new))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                one = self.ids.get(s)
                out.extend([one] if one is not None else (self.bytes[x] for x in s.encode()))
        return out

    def _gives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces gives, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.made[at], -1)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.made[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def _merge_many(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, part of each) of parts whose characters are pieces, given one after the other."""
        gives = np.append(self._gives(symbols[:-1], symbols[1:]), -1)
        gives[:-1][owner[:-1] != owner[1:]] = -1
        place, ended_ids, ended_owner = np.int64(1) << 32, [], []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            # The order of the scores, then the place from the left.
            top = np.minimum.reduceat(np.where(gives >= 0, self.order[gives] * place + np.arange(len(gives)), _NONE), first)
            over = top == _NONE
            left = np.ones(len(symbols), bool)
            if over.any():
                gone = np.repeat(over, np.diff(np.append(first, len(owner))))
                ended_ids.append(symbols[gone])
                ended_owner.append(owner[gone])
                left[gone] = False
            at = top[~over] % place
            symbols[at] = gives[at]
            left[at + 1] = False
            merged = (np.cumsum(left) - 1)[at]
            symbols, owner, gives = symbols[left], owner[left], gives[left]
            near = np.concatenate([merged, merged - 1])
            near = near[near >= 0]
            ends = near + 1 >= len(symbols)
            gives[near[ends]] = -1
            near = near[~ends]
            gives[near] = np.where(owner[near] == owner[near + 1], self._gives(symbols[near], symbols[near + 1]), -1)
        ids, owner = np.concatenate(ended_ids), np.concatenate(ended_owner)
        turn = np.argsort(owner, kind="stable")
        return ids[turn], owner[turn]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        texts = [self.normalized(x) for x in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        rows = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not len(codes):
            return np.zeros(len(rows), np.int64), np.zeros(0, np.int32)
        joins = self.joins[codes]
        begins = np.append(True, ~(joins[1:] & joins[:-1]))
        if self.cut_at_spaces:
            space = codes == ord(SPACE_SYMBOL)
            begins[1:] |= space[1:] & ~space[:-1]
        begins[rows[(rows < len(codes))]] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))

        # Equal parts by a code of their characters; the characters are compared as well.
        part = np.repeat(np.arange(len(start)), size)
        inner = np.arange(len(codes)) - start[part]
        code = np.add.reduceat(mix(codes.astype(np.uint64) + (inner.astype(np.uint64) << np.uint64(21))), start)
        _, one, of = np.unique(code, return_index=True, return_inverse=True)
        shown = one[of]
        if (size != size[shown]).any() or (codes != codes[start[shown][part] + inner]).any():
            one = of = np.arange(len(start))
        # The distinct parts: short ones of known characters in arrays, the others one by one.
        known = np.logical_and.reduceat(self.symbol[codes] >= 0, start)[one]
        short = known & (size[one] <= SIDE_BY_SIDE)
        ids, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        if short.any():
            which = np.flatnonzero(short)
            n = size[one[which]]
            at = np.repeat(start[one[which]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = self._merge_many(self.symbol[codes[at]], np.repeat(which, n))
            ids.append(x)
            owner.append(y)
        for k in np.flatnonzero(~short).tolist():
            a = start[one[k]]
            x = self._merge(codes[a : a + size[one[k]]].tobytes().decode("utf-32-le"))
            ids.append(np.array(x, np.int32))
            owner.append(np.full(len(x), k))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        turn = np.argsort(owner, kind="stable")
        ids, count = ids[turn], np.bincount(owner, minlength=len(one))
        first = np.cumsum(count) - count
        n = count[of]
        ends = np.cumsum(n)
        out = ids[np.repeat(first[of] - (ends - n), n) + np.arange(ends[-1])]
        return np.append(0, ends)[np.searchsorted(start, rows)], out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[1].tolist()

    # -------------------------------------------------------------------------------- decoding

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of rows of ids."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.names):
            raise ValueError("an id is outside the vocabulary")
        length, begin = self.length[ids], self.begin[ids]
        # What encoding put in front goes from the first piece of a row that has text.
        full = np.append(np.flatnonzero(length), len(ids))
        first = full[np.searchsorted(full, offsets[:-1])]
        first = first[first < offsets[1:]]
        lead = self.lead[ids[first]]
        begin[first] += lead
        length[first] -= lead
        ends = np.append(0, np.cumsum(length))
        data = self.blob[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        careful = np.append(0, np.cumsum(self.careful[ids]))
        watched = (careful[offsets[1:]] > careful[offsets[:-1]]).tolist()
        out = []
        for k, (a, b) in enumerate(zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True)):
            out.append(self._runs(ids[(at := slice(offsets[k], offsets[k + 1]))], ends[:-1][at] - a, length[at], data[a:b]) if watched[k] else data[a:b].decode())
        return out

    def _runs(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, data: bytes) -> str:
        """A row with byte pieces: those of a run that spell no character with their neighbours are replaced one by one, and
        control pieces end a run."""
        if CONTROL not in {self.kinds[i] for i in ids.tolist()}:
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\N{REPLACEMENT CHARACTER}")
                    at += 1

        for i, a, n in zip(ids.tolist(), begin.tolist(), length.tolist(), strict=True):
            if self.kinds[i] == BYTE:
                run += data[a : a + n]
            else:
                flush()
                run = b""
                out.append(data[a : a + n].decode())
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array([0, len(ids)]), np.array(ids, np.int64))[0]


def _held(model: bytes) -> tuple[Pieces, object]:
    """The vocabulary and the library's processor, once for each Python process."""
    held = sys.modules.setdefault("_skylattice_process", types.ModuleType("_skylattice_process"))
    key = hashlib.sha256(model).hexdigest()
    if getattr(held, "pieces_key", None) != key:
        import sentencepiece

        held.pieces, held.processor, held.pieces_key = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model), key
    return held.pieces, held.processor


#: Bytes of text, and ids, of a slice.
SLICE, IDS = 1 << 20, 1 << 18


def _encode(model: bytes, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = _held(model)
        for batch in slices(batches, "text", SLICE):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            offsets, ids = pieces.encode_all(texts)
            columns, names = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"]
            if check:
                rows, cuts = ids.tolist(), offsets.tolist()
                columns.append(pa.array([rows[a:b] == x for a, b, x in zip(cuts[:-1], cuts[1:], library.encode(texts, num_threads=1), strict=True)], pa.bool_()))
                names.append("agrees")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: bytes, check: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text), without begin and end ids; with ``check`` also ``agrees``."""
    Pieces(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model, check), "doc_id long, ids array<int>" + (", agrees boolean" if check else ""))


def _decode(model: bytes, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = _held(model)
        for batch in batches:
            column = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            part_of = np.cumsum(lengths) // IDS
            cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b <= a:
                    continue
                part = batch.slice(a, b - a)
                ids, offsets = pc.list_flatten(part.column("ids")), np.append(0, np.cumsum(lengths[a:b]))
                if ids.null_count:
                    offsets = np.append(0, np.cumsum(ids.is_valid().to_numpy(zero_copy_only=False)))[offsets]
                    ids = ids.drop_null()
                ids = ids.to_numpy().astype(np.int64)
                texts = pieces.decode_all(offsets, ids)
                columns, names = [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"]
                if check:
                    rows, ends = ids.tolist(), offsets.tolist()
                    columns.append(pa.array([x == library.decode(rows[i:j]) for x, i, j in zip(texts, ends[:-1], ends[1:], strict=True)], pa.bool_()))
                    names.append("decoded_agrees")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def decode(encoded: DataFrame, model: bytes, check: bool = False) -> DataFrame:
    """``encoded`` (ids and what else it has) with ``decoded``; with ``check`` also ``decoded_agrees``."""
    Pieces(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(model, check), f"{schema}, decoded string" + (", decoded_agrees boolean" if check else ""))


def read_model(path: str | None = None) -> bytes:
    """A vocabulary file; by default the public one of 32,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model()
    made = decode(encode(table(spark, sf_dir, "documents"), model, check=True), model, check=True)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("agrees") & F.col("decoded_agrees")).alias("agrees"),
    )
