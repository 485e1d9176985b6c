"""Block work with numpy: speckle filter, shift estimates, line and ring clipping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def _box_mean(a: np.ndarray, w: int) -> np.ndarray:
    """Means over w by w windows; beyond the edge the nearest pixel counts again."""
    p = np.pad(a, w // 2, mode="edge")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    return (s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]) / (w * w)


def lee_block(values: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Lee filter of a block and its halo, of the same shape. Means and variances are over valid pixels; the noise variance is
    the median local variance of the valid pixels, and what the local variance has beyond it is signal. Invalid pixels become 0."""
    if not valid.any():
        return np.zeros(values.shape)
    v = np.where(valid, values, 0.0)
    share = _box_mean(valid.astype(float), window)
    there = share > 0.5 / (window * window)
    mean, square = (np.where(there, _box_mean(x, window) / np.where(there, share, 1), 0.0) for x in (v, v * v))
    var = np.maximum(square - mean * mean, 0)
    noise = np.median(var[valid])
    signal = np.maximum(var - noise, 0)
    return np.where(valid, mean + signal / (signal + noise + 1e-8) * (v - mean), 0.0)


def lee_filter(pixels: DataFrame, height: int, width: int, window: int = 3, block: int = BLOCK) -> DataFrame:
    """(scene_id, y, x, filtered) of ``pixels`` (scene_id, y, x, value). A pixel is valid if its value is not null and above 0;
    a scene without a valid pixel is an error. Pixels near a block's edge also go to the neighbour as its halo, which ends at the
    raster's edge; a block is the work of one task and has a fixed size."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and 3 or more")
    half = window // 2

    def touched(k: str):
        return F.array_distinct(F.array(*(F.floor((F.col(k) + d) / block).cast("int") for d in (-half, 0, half))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["by"].iloc[0]) * block, int(pdf["bx"].iloc[0]) * block
        bottom, right = min(top + block, height), min(left + block, width)
        y0, x0 = max(0, top - half), max(0, left - half)
        shape = (min(height, bottom + half) - y0, min(width, right + half) - x0)
        y, x, value = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["value"].to_numpy(dtype=float, na_value=np.nan)
        values, valid = np.zeros(shape), np.zeros(shape, bool)
        good = value > 0
        values[y[good] - y0, x[good] - x0], valid[y[good] - y0, x[good] - x0] = value[good], True
        out = lee_block(values, valid, window)
        own = (y >= top) & (y < bottom) & (x >= left) & (x < right)
        return pd.DataFrame({"scene_id": pdf["scene_id"].iloc[0], "y": y[own], "x": x[own], "filtered": out[y[own] - y0, x[own] - x0]})

    some = pixels.groupBy("scene_id").agg(F.count_if(F.col("value") > 0).alias("n_valid"))
    dealt = pixels.withColumn("by", F.explode(touched("y"))).withColumn("bx", F.explode(touched("x")))
    dealt = dealt.filter((F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") * block < height) & (F.col("bx") * block < width))
    done = dealt.groupBy("scene_id", "by", "bx").applyInPandas(run, "scene_id long, y int, x int, filtered double")
    checked = F.when(F.col("n_valid") > 0, F.col("filtered")).otherwise(F.raise_error(F.lit("no valid pixel in the raster")).cast("double"))
    return done.join(some, "scene_id").select("scene_id", "y", "x", checked.alias("filtered"))


def _standard(a: np.ndarray) -> np.ndarray:
    """Mean 0, deviation 1, held to 5 deviations."""
    return np.clip((a - a.mean()) / (a.std() + 1e-12), -5, 5)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, response) of two small grids, as ``pair_shifts`` finds it for large ones: the shift that moves b onto a, by windowed phase correlation with a parabola at the peak; the
    response is the peak over the mean magnitude. NaN and no response where either grid is constant."""
    if min(a.std(), b.std()) < 1e-8:
        return float("nan"), float("nan"), 0.0
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.fft.fft2(_standard(a) * window) * np.conj(np.fft.fft2(_standard(b) * window))
    peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    y, x = np.unravel_index(np.round(peak, 9).argmax(), peak.shape)

    def refine(i: int, line: np.ndarray) -> float:
        before, here, after = line[i - 1], line[i], line[(i + 1) % len(line)]
        bend = before - 2 * here + after
        at = i + (0.5 * (before - after) / bend if abs(bend) > 1e-12 else 0.0)
        return at - len(line) if at > len(line) / 2 else at

    return refine(y, peak[:, x]), refine(x, peak[y]), float(peak[y, x] / (np.abs(peak).mean() + 1e-12))


#: Values that a task of a transform holds of one grid at most, but for a single row or column.
STRIP = 1 << 19


def _strips(n: int, across: int, cells: int) -> tuple[int, int]:
    """(lines in a strip, strips) of ``n`` lines of ``across`` values."""
    lines = max(1, min(n, cells // across))
    return lines, -(-n // lines)


def _grid(blobs, starts, lengths, lines: int, along: int) -> np.ndarray:
    """A strip of ``lines`` by ``along`` values from its pieces, each (lines, length) of the cells from its start on."""
    out = np.empty((lines, along), np.complex128)
    for blob, start, n in zip(blobs, starts, lengths, strict=True):
        out[:, start : start + n] = np.frombuffer(blob, np.complex128).reshape(lines, n)
    return out


def pair_shifts(pairs: DataFrame, cells: int = STRIP) -> DataFrame:
    """Shift between the two dates for each pair and channel. ``pairs``: pair_id, channel, y, x, before, after; a row for each pixel,
    of which those that are missing or null count as 0. A channel that is constant at either date has no shift (NaN).

    The transform of a grid is spread over tasks: strips of rows are transformed along x, a shuffle turns them into strips of columns,
    which are transformed along y, compared and transformed back along y, and a second shuffle gives strips of rows again, each
    with the row above and below it. A task holds ``cells`` values of a grid, or one row or column where that is longer.
    Of peaks that are equal in nine digits the first row, then the first column counts."""
    key = ["pair_id", "channel"]
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in key)
    a, b = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("before", "after"))
    shape = pairs.groupBy(*key).agg(
        (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), F.count("*").alias("n"),
        F.avg(a).alias("avg_a"), F.var_pop(a).alias("var_a"), F.avg(b).alias("avg_b"), F.var_pop(b).alias("var_b"),
    )
    total = F.col("h").cast("double") * F.col("w")
    for c in "ab":  # pixels without a row are zeros
        gap = F.col(f"avg_{c}") ** 2 * F.col("n") * (total - F.col("n")) / total
        shape = shape.withColumn(f"dev_{c}", F.sqrt((F.col(f"var_{c}") * F.col("n") + gap) / total)).withColumn(f"mean_{c}", F.col(f"avg_{c}") * F.col("n") / total)
    flat = F.least("dev_a", "dev_b") < 1e-8
    lines = F.greatest(F.lit(1), F.least("h", F.floor(F.lit(cells) / F.col("w")))).cast("int")
    shape = shape.select(*key, "h", "w", "mean_a", "dev_a", "mean_b", "dev_b", flat.alias("flat"), lines.alias("lines"))
    rows = pairs.select(*key, "y", "x", a.alias("before"), b.alias("after")).join(shape.filter(~F.col("flat")), key)
    rows = rows.withColumn("strip", F.expr("y div lines").cast("int"))
    moments = ["mean_a", "dev_a", "mean_b", "dev_b"]

    def along_x(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, top = int(first["h"]), int(first["w"]), int(first["strip"]) * int(first["lines"])
        n = min(int(first["lines"]), h - top)
        spectra = []
        for c, k in (("before", "a"), ("after", "b")):
            grid = np.zeros((n, w))
            grid[pdf["y"].to_numpy() - top, pdf["x"].to_numpy()] = pdf[c].to_numpy()
            grid = np.clip((grid - first[f"mean_{k}"]) / (first[f"dev_{k}"] + 1e-12), -5, 5)
            spectra.append(np.fft.fft(grid * np.hanning(h)[top : top + n, None] * np.hanning(w)[None, :], axis=1).T)
        wide, count = _strips(w, h, cells)
        pieces = [(k, *(z[k * wide : (k + 1) * wide].tobytes() for z in spectra)) for k in range(count)]
        return pd.DataFrame([(first["pair_id"], first["channel"], h, w, k, top, n, za, zb) for k, za, zb in pieces], columns=[*key, "h", "w", "strip", "start", "n", "za", "zb"])

    def along_y(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w = int(first["h"]), int(first["w"])
        wide, _ = _strips(w, h, cells)
        left = int(first["strip"]) * wide
        m = min(wide, w - left)
        za, zb = (np.fft.fft(_grid(pdf[c], pdf["start"], pdf["n"], m, h), axis=1) for c in ("za", "zb"))
        cross = za * np.conj(zb)
        back = np.fft.ifft(cross / np.maximum(np.abs(cross), 1e-12), axis=1)
        tall, count = _strips(h, w, cells)
        pieces = [(k, back[:, np.arange(k * tall - 1, min((k + 1) * tall, h) + 1) % h].T.tobytes()) for k in range(count)]
        return pd.DataFrame([(first["pair_id"], first["channel"], h, w, k, left, m, z) for k, z in pieces], columns=[*key, "h", "w", "strip", "start", "n", "z"])

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w = int(first["h"]), int(first["w"])
        tall, _ = _strips(h, w, cells)
        top = int(first["strip"]) * tall
        n = min(tall, h - top)
        corr = np.fft.ifft(_grid(pdf["z"], pdf["start"], pdf["n"], n + 2, w), axis=1).real
        own = corr[1:-1]
        y, x = np.unravel_index(np.round(own, 9).argmax(), own.shape)
        near = [corr[y, x], own[y, x], corr[y + 2, x], own[y, x - 1], own[y, (x + 1) % w]]
        return pd.DataFrame([(first["pair_id"], first["channel"], h, w, top + int(y), int(x), float(np.round(own[y, x], 9)), near, float(np.abs(own).sum()))], columns=[*key, "h", "w", "y", "x", "peak", "near", "mass"])

    spectra = rows.select(*key, "y", "x", "before", "after", "h", "w", "lines", "strip", *moments).groupBy(*key, "strip")
    columns = spectra.applyInPandas(along_x, f"{kinds}, h int, w int, strip int, start int, n int, za binary, zb binary").groupBy(*key, "strip")
    turned = columns.applyInPandas(along_y, f"{kinds}, h int, w int, strip int, start int, n int, z binary").groupBy(*key, "strip")
    found = turned.applyInPandas(peaks, f"{kinds}, h int, w int, y int, x int, peak double, near array<double>, mass double")
    best = F.max_by(F.struct("y", "x", "near"), F.struct(F.col("peak"), -F.col("y"), -F.col("x")))
    merged = found.groupBy(*key).agg(best.alias("p"), F.first("h").alias("h"), F.first("w").alias("w"), F.sum("mass").alias("mass"))

    def refined(at: str, before: int, after: int, extent: str):
        low, here, high = (F.col("p.near")[k] for k in (before, 1, after))
        bend = low - 2 * here + high
        place = F.col(f"p.{at}") + F.when(F.abs(bend) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(0.5 * (low - high), bend))
        return F.when(place > F.col(extent) / 2, place - F.col(extent)).otherwise(place)

    mean = F.col("mass") / (F.col("h").cast("double") * F.col("w"))
    shifts = merged.select(*key, refined("y", 0, 2, "h").alias("dy"), refined("x", 3, 4, "w").alias("dx"), (F.col("p.near")[1] / (mean + 1e-12)).alias("response"))
    none = F.lit(float("nan"))
    return shifts.unionByName(shape.filter("flat").select(*key, none.alias("dy"), none.alias("dx"), F.lit(0.0).alias("response")))


def shift_report(shifts: DataFrame) -> DataFrame:
    """For each pair the median, least and largest shift of its channels, and whether the median is over 1 and 2 pixels;
    channels without a shift (NaN) are left out."""
    dy, dx = (F.when(~F.isnan(c), F.col(c)) for c in ("dy", "dx"))
    per_pair = shifts.groupBy("pair_id").agg(
        F.percentile(dy, 0.5).alias("shift_y"), F.percentile(dx, 0.5).alias("shift_x"), F.min(dy).alias("least_y"), F.max(dy).alias("most_y"),
        F.min(dx).alias("least_x"), F.max(dx).alias("most_x"), F.percentile("response", 0.5).alias("response"),
    )
    size = F.hypot("shift_y", "shift_x")
    return per_pair.withColumn("shift", size).withColumn("over_1", size > 1).withColumn("over_2", size > 2)
