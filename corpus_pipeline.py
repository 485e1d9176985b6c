"""A corpus from raw documents to balanced shards, in five stages.

Each stage takes what the one before kept and returns rows of ``documents``; the last returns the place of
each document. Decisions are made for a doc_id: rows of one doc_id stay or go together, and rows without
doc_id are decided on as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import few, stage, table
from skylattice.llm.decontaminate import leaks
from skylattice.llm.mixing import mix_to_targets
from skylattice.llm.ngram_join import jaccard_components
from skylattice.llm.quality import judge
from skylattice.llm.sharding import shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids in ``gone``; they are broadcast only while they are few."""
    gone = stage(gone.select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.select(*COLUMNS).join(few(gone), F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, judge(docs).filter("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents: 0.8 of the five-word shingles."""
    return _without(docs, jaccard_components(docs, percent=80, width=5).filter("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, mix_to_targets(docs).filter("NOT kept"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
