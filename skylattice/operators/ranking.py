"""Ranks over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in a global order. Range partitions are sorted and numbered each by itself; their
    row counts (one small row for each partition) give each its start."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = stage(rows, "ranked").withColumn("_part", F.shiftright("_id", 33))
    starts, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("_part").count().collect())):
        starts.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_id", "_part", "_start")


def _group(by: list[str]):
    """Group columns as one text, so that null values are values too."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def running_sums(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_upto``, the sum up to and with the row in the order of ``order`` inside the groups ``by``; ``order`` must not
    repeat in a group. Range partitions are summed each by itself, and the totals of the partitions give each its start, so that
    a group that holds most rows is spread like any other."""
    rows = stage(df.withColumn("_group", _group(by)).repartitionByRange("_group", order).withColumn("_part", F.spark_partition_id()), "ranges")
    key = ["_part", "_group"]
    totals = rows.groupBy(*key).agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*key, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy(*key).orderBy(order)
    summed = rows.select("*", *(F.sum(c).over(inside).alias(f"{c}_upto") for c in columns)).join(starts, key)
    return summed.select(*df.columns, *((F.col(f"{c}_upto") + F.col(f"_{c}")).alias(f"{c}_upto") for c in columns))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q): exact quantiles, linear between neighbours, of the values that are not null. Equal values are counted
    first, and the places are looked up in running counts, so no task holds a group."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_sums(counted, by, "_v", ["_n"]).withColumn("_group", _group(by))
    totals = upto.groupBy("_group").agg(F.sum("_n").alias("n"))
    rows = upto.join(totals, "_group")
    picks = []
    for i, share in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(share))
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            hit = (F.col("_n_upto") - F.col("_n") <= at) & (at < F.col("_n_upto"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{end}{i}"))
    found = rows.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    parts = []
    for i, share in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(share))
        parts.append(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (place - F.floor(place)))
    return found.select(*by, "n", F.array(*parts).alias("q"))
