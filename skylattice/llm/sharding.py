"""Balanced contiguous shards by global prefix sums of byte sizes.

Documents are put in one order: groups of equal texts by their smallest doc_id, then doc_id inside a
group. Range partitions of that order are summed each by itself; the partition totals (one small row
for each partition) give every partition its start, and so every group its byte offset. A group goes to
the shard in which its middle byte falls, so that cuts lie at equal targets, shards are contiguous in
the order, and equal texts share a shard. Sizes are as near equal as whole groups allow. A document's
slot is its place in the order inside its shard, again from partition totals; the rows of one large
group lie in many partitions, since the order goes on by doc_id. Groups are named by 128 bits of their text; the
place of a group that holds more than a ten-thousandth of all rows is broadcast, so its rows are not shuffled to one task.

Law: ``bytes``. Size is the UTF-8 length of the text plus 1.

Defined cases: a null text counts 0 bytes and is in one group with the empty text; a null doc_id comes
first in its group; repeated rows each get a slot; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, stage, table


def _running(column: str):
    """Adds ``part`` and ``before``: the sum of ``column`` over the earlier rows of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.cumsum(x) - x
            total += int(x.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(x), part)), pa.array(before)], [*batch.schema.names, "part", "before"]
            )

    return run


def prefix_sums(df: DataFrame, order: list[str], column: str, label: str) -> tuple[DataFrame, int]:
    """``df`` with ``offset``, the sum of ``column`` over all rows that come earlier in ``order``, and
    the total. ``column`` must not be null."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, part long, before long"
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running(column), schema), label)
    totals = sorted((r["part"], r["total"]) for r in rows.groupBy("part").agg(F.sum(column).alias("total")).collect())
    starts, total = [], 0
    for part, size in totals:
        starts.append((part, total))
        total += size
    starts = df.sparkSession.createDataFrame(starts, "part long, start long")
    rows = rows.join(F.broadcast(starts), "part").withColumn("offset", F.col("start") + F.col("before"))
    return rows.drop("part", "before", "start"), total


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("key"),
        ),
        "sizes",
    )
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.sum("size").alias("bytes"), F.count("*").alias("members"))
    placed, total = prefix_sums(groups, ["leader", "key"], "bytes", "groups")
    placed = stage(
        placed.withColumn(
            "shard", F.least(F.lit(n_shards - 1), F.floor((F.col("offset") + F.col("bytes") / 2) * n_shards / max(total, 1))).cast("int")
        ),
        "placed",
    )
    counts = dict(placed.groupBy("shard").agg(F.sum("members")).collect())
    firsts = [sum(counts.get(k, 0) for k in range(s)) for s in range(n_shards)]
    dealt = join_groups(rows, placed.select("key", "members", "leader", "shard"), "key", "members").withColumn("one", F.lit(1).cast("long"))
    numbered, _ = prefix_sums(dealt, ["leader", "key", "doc_id"], "one", "slots")
    first = F.array(*(F.lit(x).cast("long") for x in firsts))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") - F.get(first, F.col("shard"))).alias("slot"))


def op9_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
