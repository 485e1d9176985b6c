"""Groups of rows as numpy arrays, many to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]


def map_groups(df: DataFrame, keys: list[str], run: Callable[[Arrays], Arrays], schema: str) -> DataFrame:
    """What ``run`` makes of the columns of each group of ``keys``, whole numbers that are not null. Groups of a partition follow each other
    in Arrow batches, so that thousands of small ones cost one call each and no frame; a task holds a batch and one group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def whole() -> Arrays:
            return run({n: np.concatenate([h[n] for h in held]) if len(held) > 1 else held[0][n] for n in held[0]})

        for batch in batches:
            if not batch.num_rows:
                continue
            if any(batch.column(k).null_count for k in keys):
                raise ValueError(f"null in the keys {keys}")
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            key = np.stack([columns[k] for k in keys])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            made = []
            for a, b in pairwise([0, *ends.tolist(), batch.num_rows]):
                now = key[:, a].tolist()
                if held and now != last:
                    made.append(whole())
                    held = []
                held.append({n: c[a:b] for n, c in columns.items()})
                last = now
            if made:
                yield pa.RecordBatch.from_pydict({n: np.concatenate([m[n] for m in made]) for n in made[0]})
        if held:
            yield pa.RecordBatch.from_pydict(whole())

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, schema)
