"""Audit ledgers as hash chains, and review queues as state machines, in batch form.

A chain is sequential inside its ledger by definition; ledgers are independent, so work is spread over them.
"""

from __future__ import annotations

import hashlib
import json
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
# FNV-1a of 32 bits, and the hash before the first event of such a chain.
FNV_START, FNV_PRIME, FNV_GENESIS = 2166136261, 16777619, "0" * 8
FINAL = ("confirmed", "rejected")


def canonical_json(**fields) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(fields, sort_keys=True, separators=(",", ":"))


def event_hash(previous: str, seq: int, stamp: str, action: str, detail: str | None) -> str:
    body = canonical_json(seq=int(seq), timestamp=stamp, action=action, detail=detail, previous_hash=previous)
    return hashlib.sha256(body.encode()).hexdigest()


def fnv_hash(previous: str, seq: int, stamp: str, action: str, detail: str | None) -> str:
    """FNV-1a of ``previous|stamp|action|detail`` over UTF-16 units, eight hexadecimal digits; a null detail is empty."""
    h = FNV_START
    for unit in memoryview(f"{previous}|{stamp}|{action}|{detail or ''}".encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * FNV_PRIME & 0xFFFFFFFF
    return f"{h:08x}"


#: (hash of an event, hash before the first) by the name of a chain.
LINKS = {"sha256": (event_hash, GENESIS), "fnv1a": (fnv_hash, FNV_GENESIS)}


def append_chain(events: DataFrame, link: str = "sha256") -> DataFrame:
    """Adds previous_hash and event_hash to events (ledger_id, seq, stamp, action, detail)."""
    hash_of, genesis = LINKS[link]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        previous, links = genesis, []
        for row in pdf.itertuples():
            this = hash_of(previous, row.seq, row.stamp, row.action, row.detail)
            links.append((previous, this))
            previous = this
        pdf["previous_hash"], pdf["event_hash"] = zip(*links, strict=True)
        return pdf

    columns = events.select("ledger_id", "seq", "stamp", "action", "detail")
    return columns.groupBy("ledger_id").applyInPandas(run, "ledger_id long, seq long, stamp string, action string, detail string, previous_hash string, event_hash string")


def json_text(value: Column) -> Column:
    """A string as JSON in ASCII; the word null for null. Texts without special signs are only quoted."""
    escapes = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")
        out = F.when((c >= F.lit(" ")) & (c <= F.lit("~")), c).otherwise(units)
        for sign, text in escapes.items():
            out = F.when(c == F.lit(sign), F.lit(text)).otherwise(out)
        return out

    special = value.rlike(r'[^\x20-\x7e]|["\\\\]')
    body = F.when(special, F.array_join(F.transform(F.split(value, ""), one), "")).otherwise(value)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def recomputed(previous: str, seq: str, stamp: str, action: str, detail: str) -> Column:
    """Hash of the event that the columns hold: SHA-256 of its canonical JSON, built by column functions."""
    parts = [
        F.lit('{"action":'), json_text(F.col(action)), F.lit(',"detail":'), json_text(F.col(detail)), F.lit(',"previous_hash":'), json_text(F.col(previous)),
        F.lit(',"seq":'), F.col(seq).cast("long").cast("string"), F.lit(',"timestamp":'), json_text(F.col(stamp)), F.lit("}"),
    ]
    return F.sha2(F.concat(*parts), 256)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a text."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32))
    return F.aggregate(units, F.lit(FNV_START).cast("long"), step)


def refnv(previous: str, seq: str, stamp: str, action: str, detail: str) -> Column:
    """The FNV hash of the event that the columns hold."""
    text = F.concat(F.col(previous), F.lit("|"), F.col(stamp), F.lit("|"), F.col(action), F.lit("|"), F.coalesce(detail, F.lit("")))
    return F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0"))


def verify_chain(chain: DataFrame, link: str = "sha256") -> DataFrame:
    """Adds ``status``: from the first row that does not fit, all rows of the ledger are broken. Hashes are recomputed row by
    row wherever the row lies; only the previous hash goes through a window, and the first bad row of each ledger
    is an aggregate that is joined back."""
    again, genesis = (recomputed, GENESIS) if link == "sha256" else (refnv, FNV_GENESIS)
    names = ("previous_hash", "seq", "stamp", "action", "detail")
    checked = chain.select("ledger_id", "seq", "previous_hash", "event_hash", (~again(*names).eqNullSafe(F.col("event_hash"))).alias("wrong"))
    expected = F.coalesce(F.lag("event_hash").over(Window.partitionBy("ledger_id").orderBy("seq")), F.lit(genesis))
    bad = checked.withColumn("loose", ~F.col("previous_hash").eqNullSafe(expected)).filter("wrong OR loose")
    first = bad.groupBy("ledger_id").agg(F.min("seq").alias("first_bad"))
    return chain.join(first, "ledger_id", "left").withColumn("status", F.when(F.col("seq") >= F.col("first_bad"), "broken").otherwise("intact")).drop("first_bad")


def tail(events: DataFrame, n: int, action: str | None = None) -> DataFrame:
    """The last ``n`` by seq, in rising order."""
    rows = events if action is None else events.filter(F.col("action") == action)
    return rows.orderBy(F.desc("seq"), F.desc("ledger_id")).limit(n).orderBy("seq", "ledger_id")


GROUPS = {"CONFIRMED": "verdicts", "REJECTED": "verdicts", "FLAGGED": "verdicts", "PURCHASE": "verdicts", "CLICK": "ops", "VIEW": "ops", "SIGNUP": "system", "ERROR": "system"}


def group_counts(events: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in GROUPS.items() for x in kv]
    group = F.try_element_at(F.create_map(*pairs), F.col("action"))
    return events.groupBy(group.alias("group_name"), "action").agg(F.count("*").alias("n")).filter("group_name IS NOT NULL")


def decide(events: DataFrame) -> DataFrame:
    """State of each candidate after its decisions (candidate_id, seq, decision) in order: the first final decision
    holds; later ones are refused, an equal one is idempotent."""
    order = Window.partitionBy("candidate_id").orderBy("seq")
    final = F.col("decision").isin(*FINAL)
    held = F.first(F.when(final, F.col("decision")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(held.isNull(), "accepted").when(held == F.col("decision"), "idempotent").otherwise("refused")
    status = F.coalesce(held, F.col("decision"))
    return events.select("candidate_id", "seq", "decision", outcome.alias("outcome"), status.alias("status"))


def queue(states: DataFrame) -> DataFrame:
    """Current state of each candidate."""
    return states.groupBy("candidate_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.count_if(F.col("outcome") == "refused").alias("refused"))
