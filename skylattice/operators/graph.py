"""Reachability on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import roots


def least_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` reaches, itself included."""
    return roots(links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), []).select(F.col("label").alias("node"), F.col("root").alias("label"))
