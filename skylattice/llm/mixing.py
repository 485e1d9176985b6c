"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Cell weights start as the cells' shares of all
tokens; each round scales them to the target share of every source, then language, then topic, and
rounds repeat until the sources' and languages' shares are right as well. Targets can contradict each other where cells are
empty. Tempered ones then leave what remains as ``gap``, once four more rounds bring the worst share no nearer. Given ones are
refused with an error, but only on proof: the logarithms of the factors of the last rounds, a number for each value of a
margin, are tried as a certificate. Any weights that meet the targets have as their mean of the three numbers of a cell
the sum of target times number, so there are none if that sum is beyond the largest cell with tokens. Targets that are only
met in the limit are no contradiction: their raking ends after ``MOST_ROUNDS`` rounds and what remains is in ``gap``. A cell's documents are kept with
probability min(1, budget * weight / tokens), where the budget is set so that the expected number of
kept tokens is the asked-for part of all tokens, cells that have too few counted at 1. The draw of
a document is a digest of its doc_id and the seed, hence the same on every run and cluster.

Targets are a share for each value of a margin, or tempered shares (share ** temper, normalised) of
what the corpus holds. A given target's values that the corpus lacks are left out; values of the corpus
that a target lacks get weight 0.

The topic is the first of a list of patterns that the text matches, else ``prose``.

Only the cell table, which is an aggregate, goes through the rounds, and it stays in Spark; the driver
sees the worst gap of a round and the sums for the budget.

Defined cases: null source, lang or text are the values ``unknown``, ``unknown`` and no tokens; a
document without words has probability 0 unless its cell's probability is 1; repeated rows share one draw; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, words_column

MARGINS = ("source", "lang", "topic")
#: (topic, pattern), the first match counts.
TOPICS = (
    ("legal", "(?i)licen[sc]e|copyright"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("tabular", r" \| "),
)
TEMPER = 0.7
KEEP = 0.8
SEED = "mix-1"
#: Rounds between two looks at the gap, and the part of the last gap that counts as no progress.
ROUNDS = 4
STALLED = 0.99
MOST_ROUNDS = 200


def cells_of(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """doc_id, the three margins and n_tokens of each row."""
    topic = F.lit("prose")
    for name, pattern in reversed(topics):
        topic = F.when(F.coalesce(F.col("text").rlike(pattern), F.lit(False)), name).otherwise(topic)
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        topic.alias("topic"),
        F.size(words_column(F.col("text"))).cast("long").alias("n_tokens"),
    )


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, temper: float = TEMPER,
    within: float = 1e-9, most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``: shares that meet the targets of every margin but for ``gap``, the
    largest difference of a share from its target."""
    spark, targets = cells.sparkSession, targets or {}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    for m in MARGINS:
        if targets.get(m) is not None:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()] or [("", 0.0)], f"{m} string, target_{m} double")
            cells = cells.join(given, m, "left").fillna(0.0, [f"target_{m}"])
        else:
            shares = cells.groupBy(m).agg(F.pow(F.sum("weight"), F.lit(temper)).alias(f"target_{m}"))
            cells = cells.join(shares, m)
    cells = stage(cells, "cells")
    # Targets sum to 1 over the values that have tokens.
    for m in MARGINS:
        there = cells.filter("tokens > 0").groupBy(m).agg(F.first(f"target_{m}").alias("x")).agg(F.sum("x")).first()[0] or 1.0
        cells = cells.withColumn(f"target_{m}", F.col(f"target_{m}") / F.lit(float(there) or 1.0))

    def share(m: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(m))

    given = any(targets.get(m) is not None for m in MARGINS)
    before, rounds = float("inf"), 0
    while True:
        for m in MARGINS:
            cells = cells.withColumn(f"log_{m}", F.lit(0.0))
        for m in MARGINS * ROUNDS:
            cells = cells.withColumn("share", share(m))
            cells = cells.withColumn(f"log_{m}", F.col(f"log_{m}") + F.when((F.col("share") > 0) & (F.col(f"target_{m}") > 0), F.ln(F.col(f"target_{m}") / F.col("share"))).otherwise(0.0))
            cells = cells.withColumn("weight", F.when(F.col("share") > 0, F.col("weight") * F.col(f"target_{m}") / F.col("share")).otherwise(F.lit(0.0))).drop("share")
        cells, rounds = stage(cells, "raked"), rounds + ROUNDS
        gaps = {
            m: cells.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"target_{m}")).alias("x"), F.sum("tokens").alias("t")).filter("t > 0").agg(F.max("x")).first()[0] or 0.0
            for m in MARGINS
        }
        gap = max(gaps.values())
        if gap <= within or rounds >= most_rounds or not given and gap > STALLED * before:
            break
        if given and _contradictory(cells):
            raise ValueError(f"no weights meet the targets: shares differ by {gaps}")
        before = gap
    return cells.drop(*(f"log_{m}" for m in MARGINS)).withColumn("gap", F.lit(float(gap)))


def _contradictory(cells: DataFrame) -> bool:
    """Whether a value with a target has no cell left, or the factors of the last rounds prove that no weights meet the targets."""
    left, wanted = cells.filter("weight > 0"), 0.0
    for m in MARGINS:
        row = (
            cells.groupBy(m).agg(F.first(f"target_{m}").alias("target"), F.max(F.when(F.col("weight") > 0, F.col(f"log_{m}"))).alias("log"), F.sum("tokens").alias("t"))
            .filter("t > 0 AND target > 0").agg(F.sum(F.col("target") * F.col("log")).alias("mean"), F.count_if(F.col("log").isNull()).alias("lost")).first()
        )
        if row["lost"]:
            return True
        wanted += row["mean"] or 0.0
    sums = F.col(f"log_{MARGINS[0]}") + F.col(f"log_{MARGINS[1]}") + F.col(f"log_{MARGINS[2]}")
    row = left.agg(F.max(sums).alias("most"), F.max(F.greatest(*(F.abs(f"log_{m}") for m in MARGINS))).alias("size")).first()
    return row["most"] is not None and wanted > row["most"] + 1e-6 * max(row["size"], 1e-3)


def calibrate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """``cells`` with ``probability``, such that the expected tokens are ``keep`` of all, if cells have them."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    reach = F.col("tokens").cast("double")

    def kept_at(budget: float) -> float:
        return cells.agg(F.sum(F.least(reach, F.lit(budget) * F.col("weight")))).first()[0] or 0.0

    low, high = 0.0, float(max(total, 1))
    while kept_at(high) < keep * total and high < total * 1e6:
        low, high = high, high * 4
    for _ in range(4):  # the sum rises with the budget: 16 steps of the interval at a time
        steps = [low + (high - low) * i / 16 for i in range(17)]
        sums = cells.agg(*(F.sum(F.least(reach, F.lit(x) * F.col("weight"))).alias(f"s{i}") for i, x in enumerate(steps))).first()
        at = next((i for i in range(1, 17) if sums[i] is not None and sums[i] >= keep * total), 16)
        low, high = steps[at - 1], steps[at]
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(high) * F.col("weight") / reach)).otherwise(F.lit(0.0))
    return cells.withColumn("probability", p)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) for each doc_id: 32 bits of a digest."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_to_targets(
    docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, keep: float = KEEP, temper: float = TEMPER, seed: str = SEED,
) -> DataFrame:
    """doc_id, margins, n_tokens, weight and probability of the cell, draw and ``kept`` of each row, and the raking's ``gap``."""
    rows = stage(cells_of(docs), "mix-rows")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = stage(calibrate(rake(cells, targets, temper), keep).select(*MARGINS, "weight", "probability", "gap"), "mix-cells")
    return (
        rows.join(fitted, list(MARGINS)).withColumn("draw", draw(F.col("doc_id"), seed)).withColumn("kept", F.col("draw") < F.col("probability"))
        .select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "draw", "kept", "gap")
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9)).withColumn("probability", F.round("probability", 9)).withColumn("gap", F.round("gap", 9))
