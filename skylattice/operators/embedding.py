"""Batch jobs around callables that the user gives: an encoder of rows and a scorer of patches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .groups import Arrays, map_groups


def hashed_encoder(dimension: int = 32) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder of texts: signed sums over hashed words, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for word in text.split():
                h = hashlib.md5(word.encode()).hexdigest()
                out[i, int(h[:8], 16) % dimension] += 1 if int(h[8], 16) % 2 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encode_rows(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """(key, vector, error): vectors batch by batch. Rows of a batch that fails are tried one by one, so that only those
    that fail alone keep an error."""
    kind = rows.schema[key].dataType.simpleString()

    def encoded(texts: list[str]) -> list[tuple]:
        try:
            return [(v.astype(np.float32), None) for v in encoder(texts)]
        except Exception as e:  # the job goes on; the rows say why they have no vector
            return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [x for t in texts for x in encoded([t])]

    def run(parts):
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                piece = pdf.iloc[a : a + batch]
                made = encoded([t or "" for t in piece[text]])
                yield pd.DataFrame({key: piece[key].to_numpy(), "vector": [v for v, _ in made], "error": [e for _, e in made]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>, error string")


def score_patches(pixels: DataFrame, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray], patch: int = 256) -> DataFrame:
    """Probabilities by a callable on whole patches. ``pixels``: scene_id, y, x, before, after, valid. Invalid
    pixels get 0; a probability outside [0, 1] is an error."""
    from pyspark.sql import functions as F

    def run(rows: Arrays) -> Arrays:
        y, x = rows["y"] % patch, rows["x"] % patch
        a, b = np.zeros((patch, patch)), np.zeros((patch, patch))
        a[y, x], b[y, x] = rows["before"], rows["after"]
        p = scorer(a, b)[y, x]
        if not ((p >= 0) & (p <= 1)).all():
            raise ValueError("a probability is outside [0, 1]")
        return {"scene_id": rows["scene_id"], "y": rows["y"], "x": rows["x"], "p": np.where(rows["valid"], p, 0.0), "valid": rows["valid"]}

    held = pixels.select(F.col("scene_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("before").cast("double"), F.col("after").cast("double"), F.coalesce("valid", F.lit(False)).alias("valid"))
    held = held.select("*", F.floor(F.col("y") / patch).alias("py"), F.floor(F.col("x") / patch).alias("px"))
    return map_groups(held, ["scene_id", "py", "px"], run, "scene_id long, y int, x int, p double, valid boolean")
