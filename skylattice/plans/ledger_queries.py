"""Queries of ledgers and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, reports
from ..sources import sinks
from ..storage import new_path, stage
from . import views
from .registry import query
from .views import LEDGER

_BODY = """'{"action":' || to_json(action) || ',"detail":' || to_json(detail) || ',"previous_hash":"' || previous || '","seq":' || seq || ',"timestamp":"' || stamp || '"}'"""
_CHAIN = f"""WITH RECURSIVE {LEDGER}, chain AS (SELECT ledger_id, seq, stamp, action, detail, repeat('0', 64) AS previous_hash, sha256({_BODY.replace('previous ||', "repeat('0', 64) ||")}) AS event_hash FROM ledger WHERE seq = 1
 UNION ALL SELECT l.ledger_id, l.seq, l.stamp, l.action, l.detail, c.event_hash, sha256('{{"action":' || to_json(l.action) || ',"detail":' || to_json(l.detail) || ',"previous_hash":"' || c.event_hash || '","seq":' || l.seq || ',"timestamp":"' || l.stamp || '"}}') FROM chain c JOIN ledger l ON l.ledger_id = c.ledger_id AND l.seq = c.seq + 1)"""


@query("K3", f"{_CHAIN} SELECT ledger_id, seq, previous_hash, event_hash FROM chain")
def k3(spark, sf):
    return ledger.append_chain(views.ledger(spark, sf)).select("ledger_id", "seq", "previous_hash", "event_hash")


def _tampered(spark, sf):
    chain = stage(ledger.append_chain(views.ledger(spark, sf)), "ledger")
    changed = (F.col("ledger_id") % 7 == 3) & (F.col("seq") == 5)
    return chain.withColumn("detail", F.when(changed, "changed").otherwise(F.col("detail")))


@query("E8", f"WITH {LEDGER} SELECT ledger_id, seq, CASE WHEN ledger_id % 7 = 3 AND seq >= 5 THEN 'broken' ELSE 'intact' END AS status FROM ledger")
def e8(spark, sf):
    return ledger.verify_chain(_tampered(spark, sf)).select("ledger_id", "seq", "status")


@query("A18", f"WITH {LEDGER} SELECT ledger_id, seq, stamp, action, CASE WHEN ledger_id % 7 = 3 AND seq = 5 THEN 'changed' ELSE detail END AS detail, CASE WHEN ledger_id % 7 = 3 AND seq >= 5 THEN 'broken' ELSE 'intact' END AS status FROM ledger")
def a18(spark, sf):
    """The ledgers with the state of their chains through the CSV export."""
    path = new_path(spark, "ledger")
    sinks.write_csv(ledger.verify_chain(_tampered(spark, sf)).select("ledger_id", "seq", "stamp", "action", "detail", "status"), path)
    return sinks.read_csv(spark, path, "ledger_id long, seq long, stamp string, action string, detail string, status string")


@query("E7", f"WITH {LEDGER} SELECT ledger_id, seq, action FROM ledger WHERE action = 'PURCHASE' ORDER BY seq DESC, ledger_id DESC LIMIT 40")
def e7(spark, sf):
    return ledger.tail(views.ledger(spark, sf), 40, "PURCHASE").select("ledger_id", "seq", "action")


_FNV = "format('{{:08x}}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({txt}, ''), lambda ch: ord(ch)::BIGINT)), lambda h, ch: (xor(h, ch) * 16777619) % 4294967296))"
_LINKED = f"""WITH RECURSIVE {LEDGER}, chain AS (SELECT ledger_id, seq, '00000000' AS previous_hash, {_FNV.format(txt="'00000000|' || stamp || '|' || action || '|' || coalesce(detail, '')")} AS event_hash FROM ledger WHERE seq = 1
 UNION ALL SELECT l.ledger_id, l.seq, c.event_hash, {_FNV.format(txt="c.event_hash || '|' || l.stamp || '|' || l.action || '|' || coalesce(l.detail, '')")} FROM chain c JOIN ledger l ON l.ledger_id = c.ledger_id AND l.seq = c.seq + 1)"""


@query("E9", f"{_LINKED} SELECT ledger_id, seq, previous_hash, event_hash, CASE WHEN ledger_id % 7 = 3 AND seq >= 5 THEN 'broken' ELSE 'intact' END AS status FROM chain")
def e9(spark, sf):
    """Linked hashes of 32 bits, one event changed after the fact, and the check that finds it."""
    chain = stage(ledger.append_chain(views.ledger(spark, sf), "fnv1a"), "ledger")
    changed = (F.col("ledger_id") % 7 == 3) & (F.col("seq") == 5)
    tampered = chain.withColumn("detail", F.when(changed, "changed").otherwise(F.col("detail")))
    return ledger.verify_chain(tampered, "fnv1a").select("ledger_id", "seq", "previous_hash", "event_hash", "status")


@query("D35", f"WITH {LEDGER} SELECT CASE WHEN action = 'PURCHASE' THEN 'verdicts' WHEN action IN ('CLICK', 'VIEW') THEN 'ops' ELSE 'system' END AS group_name, action, count(*) AS n FROM ledger GROUP BY ALL")
def d35(spark, sf):
    return ledger.group_counts(views.ledger(spark, sf))


@query("H5", f"WITH {LEDGER} SELECT event_id, sha256('{{\"action\":' || to_json(action) || ',\"detail\":' || to_json(detail) || ',\"previous_hash\":\"' || repeat('0', 64) || '\",\"seq\":' || seq || ',\"timestamp\":\"' || stamp || '\"}}') AS h FROM ledger")
def h5(spark, sf):
    rows = views.ledger(spark, sf).withColumn("previous_hash", F.lit(ledger.GENESIS))
    return rows.select("event_id", ledger.recomputed("previous_hash", "seq", "stamp", "action", "detail").alias("h"))


_REVIEW = "rv AS (SELECT ledger_id AS candidate_id, seq, CASE action WHEN 'PURCHASE' THEN 'confirmed' WHEN 'ERROR' THEN 'rejected' WHEN 'CLICK' THEN 'flagged' ELSE 'pending' END AS decision FROM ledger)"
_STATE = f"WITH {LEDGER}, {_REVIEW}, f AS (SELECT candidate_id, arg_min(decision, seq) AS held, min(seq) AS first_seq FROM rv WHERE decision IN ('confirmed', 'rejected') GROUP BY candidate_id), st AS (SELECT rv.candidate_id, rv.seq, rv.decision, CASE WHEN f.first_seq IS NULL OR rv.seq <= f.first_seq THEN 'accepted' WHEN rv.decision = f.held THEN 'idempotent' ELSE 'refused' END AS outcome, CASE WHEN f.first_seq IS NULL OR rv.seq <= f.first_seq THEN rv.decision ELSE f.held END AS status FROM rv LEFT JOIN f USING (candidate_id))"


def decisions(spark, sf):
    a = F.col("action")
    d = F.when(a == "PURCHASE", "confirmed").when(a == "ERROR", "rejected").when(a == "CLICK", "flagged").otherwise("pending")
    return views.ledger(spark, sf).select(F.col("ledger_id").alias("candidate_id"), "seq", d.alias("decision"))


@query("K2", f"{_STATE} SELECT * FROM st")
def k2(spark, sf):
    return ledger.decide(decisions(spark, sf))


@query("K4", f"{_STATE} SELECT candidate_id, arg_max(status, seq) AS status, max(seq) AS seq, count(*) FILTER (outcome = 'refused') AS refused FROM st GROUP BY candidate_id")
def k4(spark, sf):
    return ledger.queue(ledger.decide(decisions(spark, sf)))


@query("A21", f"""{_STATE}, inv AS (SELECT ledger_id, 'investigation' AS part, 1::BIGINT AS seq, count(*)::VARCHAR AS value FROM ledger GROUP BY ledger_id), tl AS (SELECT ledger_id, 'timeline' AS part, seq, stamp AS value FROM ledger),
 an AS (SELECT ledger_id, 'analysis' AS part, row_number() OVER (PARTITION BY ledger_id ORDER BY action) AS seq, action || ' ' || count(*) AS value FROM ledger GROUP BY ledger_id, action), ev AS (SELECT ledger_id, 'evidence' AS part, row_number() OVER (PARTITION BY ledger_id ORDER BY seq) AS seq, event_id::VARCHAR AS value FROM ledger WHERE action = 'PURCHASE'),
 pr AS (SELECT ledger_id, 'provenance' AS part, 1::BIGINT AS seq, min(stamp) || ' ' || max(stamp) AS value FROM ledger GROUP BY ledger_id), rw AS (SELECT candidate_id AS ledger_id, 'review' AS part, row_number() OVER (PARTITION BY candidate_id ORDER BY st.seq) AS seq, outcome AS value FROM st)
 SELECT * FROM inv UNION ALL SELECT * FROM tl UNION ALL SELECT * FROM an UNION ALL SELECT * FROM ev UNION ALL SELECT * FROM pr UNION ALL SELECT * FROM rw""")
def a21(spark, sf):
    """The six parts of each case, written and read back."""
    rows = stage(views.ledger(spark, sf), "ledger")
    text = lambda c: c.cast("string").alias("value")
    review = ledger.decide(decisions(spark, sf)).select(F.col("candidate_id").alias("ledger_id"), "seq", F.col("outcome").alias("value"))
    parts = {
        "investigation": rows.groupBy("ledger_id").agg(text(F.count("*"))),
        "timeline": rows.select("ledger_id", "seq", F.col("stamp").alias("value")),
        "analysis": rows.groupBy("ledger_id", "action").count().select("ledger_id", "action", F.concat_ws(" ", "action", "count").alias("value")),
        "evidence": rows.filter("action = 'PURCHASE'").select("ledger_id", "seq", text(F.col("event_id"))),
        "provenance": rows.groupBy("ledger_id").agg(F.concat_ws(" ", F.min("stamp"), F.max("stamp")).alias("value")),
        "review": review,
    }
    order = {"investigation": "value", "timeline": "seq", "analysis": "action", "evidence": "seq", "provenance": "value", "review": "seq"}
    path = new_path(spark, "bundles")
    sinks.write_bundles(reports.bundle(parts, "ledger_id", order), "ledger_id", path)
    back = sinks.read_bundles(spark, "ledger_id", "long", path)
    return back.select("ledger_id", "part", "seq", F.get_json_object("body", "$.value").alias("value"))
