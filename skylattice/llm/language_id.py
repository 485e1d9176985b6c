"""Language identification by a byte convolutional network, in numpy.

Bytes of a fixed-length window are embedded; filters of several widths slide over them; each filter's
largest response (after a rectifier) is a feature, and a softmax over the features gives the language.
Training (Adam on cross-entropy; only the largest response of a filter gets a gradient) runs on the
driver, on a bounded sample: at most ``PER_LANGUAGE`` labelled documents of each language, and with many
languages fewer of each, so that all have at most ``MOST_WINDOWS`` or one each; one window of each document. Prediction runs in tasks over every
window of every text: filter responses are sums of look-ups by byte and by pair of bytes, so a batch of
windows needs no loop over positions. A document's probabilities are the mean over its windows,
weighted by their bytes.

Only text is read for a prediction. Rows whose crc32(doc_id as text) mod 3 is 1 are held out of the
training, as are rows without language.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every row if
nothing can be learned; a null doc_id is not held out; repeated rows each get a row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, slices, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PER_LANGUAGE = 1500
MOST_WINDOWS = 150_000
EPOCHS = 12
#: Batches that training takes at least; a small sample is gone through more often.
LEAST_STEPS = 1200
UNKNOWN = "und"


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {"embed": draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"w{w}"] = draw.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.weights[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.weights["bias"] = np.zeros(len(languages), np.float32)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, dict]:
        x = self.weights["embed"][windows]
        kept, pooled = {"x": x}, []
        for w in WIDTHS:
            m = windows.shape[1] - w + 1
            runs = np.concatenate([x[:, j : j + m] for j in range(w)], axis=2)
            held = runs @ self.weights[f"w{w}"] + self.weights[f"b{w}"]
            at = held.argmax(axis=1)
            top = np.take_along_axis(held, at[:, None], 1)[:, 0]
            kept[w] = (at, top > 0)
            pooled.append(np.maximum(top, 0))
        return np.concatenate(pooled, axis=1), kept

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of a batch and its gradient by each weight."""
        features, kept = self._pooled(windows)
        logits = features @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        n = len(windows)
        loss = float(-np.log(p[np.arange(n), target] + 1e-12).mean())
        p[np.arange(n), target] -= 1
        p /= n
        out = {"out": features.T @ p, "bias": p.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        back = p @ self.weights["out"].T
        for k, w in enumerate(WIDTHS):
            at, active = kept[w]
            d = back[:, k * FILTERS : (k + 1) * FILTERS] * active
            weight = np.zeros_like(self.weights[f"w{w}"])
            for j in range(w):
                byte = np.take_along_axis(windows, at + j, 1)
                vector = self.weights["embed"][byte]
                weight[j * EMBED : (j + 1) * EMBED] = np.einsum("nfe,nf->ef", vector, d)
                np.add.at(out["embed"], byte, d[:, :, None] * self.weights[f"w{w}"][j * EMBED : (j + 1) * EMBED].T[None])
            out[f"w{w}"], out[f"b{w}"] = weight, d.sum(axis=0)
        return loss, out

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, seed: int = 7, least_steps: int = LEAST_STEPS) -> float:
        draw, step, loss = np.random.default_rng(seed), 0, 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(max(epochs, -(-least_steps // -(-len(windows) // batch)))):
            order = draw.permutation(len(windows))
            for a in range(0, len(order), batch):
                chosen = order[a : a + batch]
                loss, slope = self.gradients(windows[chosen], target[chosen])
                step += 1
                for k, g in slope.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def tables(self) -> dict:
        """Filter responses by pairs of bytes (and by a single last byte), for prediction."""
        found: dict = {"out": self.weights["out"], "bias": self.weights["bias"], "languages": self.languages}
        for w in WIDTHS:
            by_byte = [self.weights["embed"] @ self.weights[f"w{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            by_byte[0] = by_byte[0] + self.weights[f"b{w}"]
            parts = []
            for j in range(0, w, 2):
                if j + 1 < w:
                    parts.append((j, 2, (by_byte[j][:, None] + by_byte[j + 1][None]).reshape(65536, FILTERS)))
                else:
                    parts.append((j, 1, by_byte[j]))
            found[w] = parts
        return found


def probabilities(windows: np.ndarray, tables: dict) -> np.ndarray:
    """Softmax probabilities of each window (rows of bytes)."""
    pairs = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
    pooled = []
    for w in WIDTHS:
        m, held = windows.shape[1] - w + 1, None
        for j, size, by in tables[w]:
            part = by[pairs[:, j : j + m] if size == 2 else windows[:, j : j + m]]
            held = part if held is None else np.add(held, part, out=held)
        pooled.append(np.maximum(held.max(axis=1), 0))
    logits = np.concatenate(pooled, axis=1) @ tables["out"] + tables["bias"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def windows_of(column: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, padded with spaces: bytes, row of each, and bytes of text in each."""
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    n = -(-size // window)
    row = np.repeat(np.arange(len(size)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = (offsets[:-1] - offsets[0])[row] + step * window
    length = np.minimum(window, size[row] - step * window)
    padded = np.concatenate([data, np.full(window, 0x20, np.uint8)])
    out = padded[start[:, None] + np.arange(window)]
    out[np.arange(window)[None] >= length[:, None]] = 0x20
    return out, row, length


def _predict(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables.value
        names = np.array(known["languages"], object)
        for part in slices(batches, "text", 1 << 20):
            found, row, length = windows_of(part.column("text"))
            p = np.concatenate([np.zeros((0, len(names)))] + [probabilities(found[a : a + 256], known) for a in range(0, len(found), 256)])
            total = np.zeros((part.num_rows, len(names)))
            np.add.at(total, row, p * length[:, None])
            weight = np.bincount(row, weights=length, minlength=part.num_rows)
            total /= np.maximum(weight, 1)[:, None]
            letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool) & (weight > 0)
            lang = np.where(letter, names[total.argmax(axis=1)], UNKNOWN)
            score = np.where(letter, np.clip(total.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_windows: int = MOST_WINDOWS, epochs: int = EPOCHS) -> ByteNetwork | None:
    """A network fitted on the rows that are not held out; None if there are none."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND NOT held_out AND letter")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    counts = {r["lang"]: r["count"] for r in counts}
    per_language = max(1, min(per_language, most_windows // len(counts)))
    # 1.2 times what is needed on average, then cut: the bound holds whatever the draw gives.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(1.0, 1.2 * per_language / n)))
    span = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(4)), span) + 1).cast("int"), F.lit(WINDOW))
    rows = labelled.filter(chosen).select("lang", "doc_id", draw.alias("draw"), piece.alias("piece")).orderBy("draw", "doc_id").limit(2 * per_language * len(counts)).collect()
    languages, taken = sorted(counts), dict.fromkeys(counts, 0)
    pieces, target = [], []
    for r in rows:
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            pieces.append(r["piece"])
            target.append(languages.index(r["lang"]))
    found, row, _ = windows_of(pa.array(pieces, pa.string()))
    first = np.unique(row, return_index=True)[1]
    net = ByteNetwork(languages)
    net.fit(found[first], np.array(target)[row[first]], epochs)
    return net


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    net = train(rows, **how)
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    tables = docs.sparkSession.sparkContext.broadcast(net.tables())
    return rows.select("doc_id", "text", "held_out", "letter").mapInArrow(_predict(tables), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
