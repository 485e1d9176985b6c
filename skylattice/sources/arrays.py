"""NPY arrays (height x width x channels) as pixel rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, y int, x int, channels array<float>, finite boolean"
HEADER = "path string, height int, width int, n_channels int, dtype string, finite boolean"


def _load(data: bytes) -> np.ndarray:
    array = np.load(io.BytesIO(data), allow_pickle=False)
    return array if array.ndim == 3 else array.reshape(*array.shape, 1)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            array = _load(data.as_py())
            height, width, channels = array.shape
            for y in range(height):  # a row of pixels at a time
                line = np.ascontiguousarray(array[y], np.float32)
                offsets = pa.array(np.arange(width + 1, dtype=np.int32) * channels)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * width), pa.array(np.full(width, y, np.int32)), pa.array(np.arange(width, dtype=np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(line.reshape(-1))), pa.array(np.isfinite(line).all(axis=1)),
                    ],
                    ["path", "y", "x", "channels", "finite"],
                )


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            a = _load(data.as_py())
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "height": a.shape[0], "width": a.shape[1], "n_channels": a.shape[2], "dtype": str(a.dtype), "finite": bool(np.isfinite(a).all())}],
                pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("n_channels", pa.int32()), ("dtype", pa.string()), ("finite", pa.bool_())]),
            )


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder).select("path", "content")


def pixels(held: DataFrame) -> DataFrame:
    """One row for each pixel of the files (path, content); a file is read by one task."""
    return held.select("path", "content").mapInArrow(_pixels, ROWS)


def inventory(held: DataFrame) -> DataFrame:
    """Files by shape, type and channels."""
    shapes = held.select("path", "content").mapInArrow(_headers, HEADER)
    return shapes.groupBy("height", "width", "n_channels", "dtype").agg(F.count("*").alias("files"), F.count_if("finite").alias("finite"))
