"""Reports of builds and indexes: what was found, added, refused, and whether two id sets agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog
from .ranking import running_sums


def build_report(old: DataFrame, batch: DataFrame, files: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row for a catalogue build: discovered rows, added and updated keys, keys after it, keys whose file is missing, and how
    many keys the batch holds more than once. ``files``: the keys with a file."""
    action = F.col("action")
    acts = catalog.merge_actions(old, batch, key, values, order).agg(F.count_if(action == "add").alias("added"), F.count_if(action == "update").alias("updated"))
    counts = batch.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("discovered"), F.count_if(F.col("count") > 1).alias("duplicates"))
    after = old.select(key).union(batch.select(key)).distinct()
    there = files.select(key, F.lit(True).alias("there")).distinct()
    total = after.join(there, key, "left").agg(F.count("*").alias("total"), F.count_if(F.col("there").isNull()).alias("missing"))
    return acts.join(counts).join(total)


def embedding_report(discovered: DataFrame, catalogue: DataFrame, cached: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """One row for an embedding build: rows found, found and catalogued, found in the cache, to be made, added, failed. ``made``: key and
    error of the rows that were encoded."""
    flag = lambda df, name: df.select(key, F.lit(True).alias(name)).distinct()
    rows = discovered.select(key).join(flag(catalogue, "c"), key, "left").join(flag(cached, "h"), key, "left").join(made.select(key, F.lit(True).alias("m"), "error"), key, "left")
    return rows.agg(
        F.count("*").alias("discovered"), F.count("c").alias("catalogued"), F.count("h").alias("hits"), F.count_if(F.col("h").isNull()).alias("new"),
        F.count_if(F.col("m") & F.col("error").isNull()).alias("added"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def id_rules(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(rule, id, copies): ids that only one side holds, or that one side holds more than once."""
    counts = index.groupBy("id").agg(F.count("*").alias("i")).join(ids.groupBy("id").agg(F.count("*").alias("m")), "id", "full")
    rules = [("only_in_index", F.col("m").isNull(), F.col("i")), ("only_in_map", F.col("i").isNull(), F.col("m")), ("twice_in_index", F.col("i") > 1, F.col("i")), ("twice_in_map", F.col("m") > 1, F.col("m"))]
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("rule"), n.alias("copies"))) for name, when, n in rules)))
    return counts.select("id", F.explode(found).alias("r")).select("r.rule", "id", "r.copies")


def id_summary(index: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: both sizes, the broken rules, and whether index and map agree."""
    broken = id_rules(index, ids).agg(*(F.count_if(F.col("rule") == r).alias(r) for r in ("only_in_index", "only_in_map", "twice_in_index", "twice_in_map")))
    sizes = index.agg(F.count("*").alias("index_size")).join(ids.agg(F.count("*").alias("map_size")))
    total = F.col("only_in_index") + F.col("only_in_map") + F.col("twice_in_index") + F.col("twice_in_map")
    return sizes.join(broken).withColumn("consistent", total == 0)


def bundle(parts: dict[str, DataFrame], key: str, order: dict[str, str]) -> DataFrame:
    """Export of a case as lines (key, part, seq, body): each row of each part as JSON, numbered from 1 in the order of its column ``order[part]``.
    The key leads the lines, so a case with very many rows is spread over tasks and files like any other. An id without rows in a part
    has no line there; null values are written."""
    lines = None
    for name, rows in parts.items():
        body = F.to_json(F.struct(*(c for c in rows.columns if c != key)), {"ignoreNullFields": "false"})
        own = rows.select(F.col(key), F.lit(name).alias("part"), F.struct(F.col(order[name]), body.alias("b")).alias("_at"), F.monotonically_increasing_id().alias("_id"), body.alias("body"))
        placed = running_sums(own.withColumn("_at", F.struct("_at", "_id")).drop("_id").withColumn("_one", F.lit(1)), [key], "_at", ["_one"])
        placed = placed.select(key, "part", F.col("_one_upto").cast("long").alias("seq"), "body")
        lines = placed if lines is None else lines.unionByName(placed)
    return lines
