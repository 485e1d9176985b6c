"""Structured Streaming: incremental ingest, review decisions and ledgers over streams of events."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import storage
from ..operators import embedding
from ..operators.ledger import FINAL, GENESIS, event_hash


#: Folders of keys. A batch reads the keys of the buckets that it touches.
BUCKETS = 64


def commits(spark: SparkSession, path: str) -> list[dict]:
    """What each finished batch has done, in the order of their numbers."""
    names = [x for x in storage.list_names(spark, f"{path}/commits") if x.endswith(".json")]
    return sorted((json.loads(storage.read_text(spark, f"{path}/commits/{x}")) for x in names), key=lambda c: c["number"])


def read_ingested(spark: SparkSession, path: str, table: str, done: list[dict] | None = None) -> DataFrame | None:
    """``index`` or ``catalog`` as the finished batches left it; None before the first that added rows."""
    folders = [f"{path}/{table}/batch={c['batch']}" for c in (commits(spark, path) if done is None else done) if c["added"]]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*folders) if folders else None


def ingest(stream: DataFrame, path: str, checkpoint: str, encoder: Callable[[list[str]], np.ndarray], text: str, key: str = "tile_id", buckets: int = BUCKETS):
    """Encode rows of a stream whose key is not indexed yet, append their vectors to ``path``/index and their other columns
    to ``path``/catalog. Runs over what is there and stops.

    Both tables lie in folders by batch and bucket of the key, so a batch reads only the keys in buckets that it touches
    and rewrites nothing. A batch is there once its commit file is: one that dies before is written over when it runs
    again, one that is replayed later is passed over. Rows that the encoder refuses are counted as failed and stay out,
    to be tried when they land again. One writer at a time.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{run}-{batch_id:08d}"
        done = commits(spark, path)
        if any(c["batch"] == name for c in done):
            return
        landed = storage.stage(batch.dropDuplicates([key]).withColumn("bucket", storage.bucket(key, buckets)), "landed")
        touched = [r[0] for r in landed.select("bucket").distinct().collect()]
        known = read_ingested(spark, path, "index", done)
        fresh = landed if known is None else landed.join(known.filter(F.col("bucket").isin(touched)).select(key), key, "left_anti")
        vectors = storage.stage(embedding.encode_rows(fresh, key, text, encoder), "vectors")
        good = vectors.filter("error IS NULL").select(key, "vector")
        n = vectors.agg(F.count_if(F.col("error").isNull()).alias("added"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
        if n["added"]:
            good.withColumn("bucket", storage.bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/index/batch={name}")
            landed.join(good.select(key), key, "left_semi").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/catalog/batch={name}")
        before, rows = sum(c["added"] for c in done), landed.count()
        report = {
            "number": len(done), "batch": name, "status": "success" if n["added"] else "failed" if n["failed"] else "already_indexed", "landed": rows,
            "count_before": before, "count_after": before + n["added"], "added": n["added"], "failed": n["failed"], "already_indexed": rows - n["added"] - n["failed"],
        }
        storage.write_text(spark, f"{path}/commits/{name}.json", json.dumps(report))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_report(spark: SparkSession, path: str) -> DataFrame:
    """A row for each finished batch."""
    schema = "number int, batch string, status string, landed long, count_before long, count_after long, added long, failed long, already_indexed long"
    return spark.createDataFrame([tuple(c[f.split()[0]] for f in schema.split(", ")) for c in commits(spark, path)], schema)


def _by_seq(parts: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """seq and ``columns`` of the rows of one key in the order of seq, as tuples: groups are small and many, and each frame made of one costs more than its rows."""
    rows = [row for p in parts for row in zip(*(p[c].tolist() for c in ("seq", *columns)), strict=True)]
    return iter(sorted(rows, key=lambda row: row[0]))


def _decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get[0] if state.exists else None
    out = []
    for seq, decision in _by_seq(parts, "decision"):
        if held is None:
            outcome, status = "accepted", decision
            held = decision if decision in FINAL else None
        else:
            outcome, status = "idempotent" if decision == held else "refused", held
        out.append((key[0], seq, decision, outcome, status))
    if held is not None:
        state.update((held,))
    yield pd.DataFrame(out, columns=["candidate_id", "seq", "decision", "outcome", "status"])


def review(stream: DataFrame) -> DataFrame:
    """Decisions (candidate_id, seq, decision) with outcome and status; final states hold across batches."""
    return stream.groupBy("candidate_id").applyInPandasWithState(
        _decide, "candidate_id long, seq long, decision string, outcome string, status string", "held string", "append", GroupStateTimeout.NoTimeout
    )


def _append(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else GENESIS
    out = []
    for seq, stamp, action, detail in _by_seq(parts, "stamp", "action", "detail"):
        this = event_hash(previous, seq, stamp, action, detail)
        out.append((key[0], seq, previous, this))
        previous = this
    state.update((previous,))
    yield pd.DataFrame(out, columns=["ledger_id", "seq", "previous_hash", "event_hash"])


def audit(stream: DataFrame) -> DataFrame:
    """Hash chains that go on from batch to batch, one for each ledger."""
    return stream.groupBy("ledger_id").applyInPandasWithState(
        _append, "ledger_id long, seq long, previous_hash string, event_hash string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def replay(spark: SparkSession, rows: DataFrame, folder: str, job, batches: int = 3) -> DataFrame:
    """The rows landed in ``batches`` slices of rising seq, each streamed through ``job`` before the next one lands;
    state goes on in the checkpoint. Returns the output as a table. What makes the rows runs once, not for each slice."""
    rows = storage.stage(rows, "replayed")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    slice_of = F.least(F.floor((F.col("seq") - F.lit(low or 0)) * batches / F.lit(max((high or 0) - (low or 0), 1))), F.lit(batches - 1))
    for k in range(batches):
        rows.filter(slice_of == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = job(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
