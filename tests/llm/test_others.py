import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylattice.llm import decontaminate, language_id, licenses, lm_score, mixing, quality, sharding, warc
from skylattice.llm.common import join_groups

from .conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------------------------- quality rules


def test_quality_base_counts(frame, odd_docs):
    rows = odd_docs + [(30, "a b\n\na b\n \na b\n" + "p q r s t u v w " * 3, "en", "a"), (31, "#x $$ %1 & | <> *" * 9, "en", "a")]
    found = {str(r["doc_id"]): r for r in quality.judge(frame(rows)).collect()}
    for doc_id, text, *_ in rows:
        words = re.findall(WORD, text or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        r = found[str(doc_id)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(again)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdict(frame):
    common = "the of and to in a is that for it".split()

    def clean(seed):
        return " ".join(w if i % 3 else common[(i * 7 + seed) % 10] for i, w in enumerate(prose(seed, 400)))

    docs = [(k, clean(k), "en", "a") for k in range(30)]
    junk = [(100, clean(100).upper(), "en", "a"), (101, " ".join(f"{w}$$$" for w in clean(101).split()), "en", "a"), (102, " ".join(prose(102, 900)), "en", "a")]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(frame(docs + junk)).collect()}
    assert all(found[k] for k in range(30))
    assert not any(found[k] for k in (100, 101, 102))


def test_jensen_shannon(spark):
    row = spark.range(1).select(
        quality.jensen_shannon(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"),
        quality.jensen_shannon(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("same"),
    ).first()
    assert row["far"] == pytest.approx(1.0) and row["same"] == pytest.approx(0.0)


def test_quality_empty(frame):
    assert quality.judge(frame([])).count() == 0


# ----------------------------------------------------------------------------------- decontamination


def brute_leaks(docs, items):
    def grams(text):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    out = defaultdict(int)
    for doc_id, text, *_ in docs:
        for item_id, body in items:
            need = grams(body)
            if doc_id is not None and need and 100 * len(need & grams(text)) >= 80 * len(need):
                out[doc_id, item_id] = max(out[doc_id, item_id], len(need & grams(text)))
    return dict(out)


def test_leaks(frame, spark, odd_docs):
    long = odd_docs[9][1].split()
    items = [(k, " ".join(long[40 * k : 40 * k + 8 + 3 * k])) for k in range(12)]
    items += [(50, "one two"), (51, None), (52, ""), (53, " ".join(long[100:110] + ["x"] + long[110:140])), (54, " ".join(prose(900, 30))), (55, " ".join(long[:21]).upper() + "!")]
    docs = odd_docs + [(40, " ".join(prose(41, 900) + long[200:240] + prose(42, 900)), "en", "a")]
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.leaks(frame(docs), table).collect()}
    assert found == brute_leaks(docs, items)
    sketch = decontaminate.sketches(decontaminate.item_shingles(table))
    sizes = {r["item_id"]: (r["k"], r["hits"]) for r in sketch.groupBy("item_id").agg(F.count("*").alias("k"), F.first("hits").alias("hits")).collect()}
    assert sizes[0] == (1, 1) and sizes[11] == (15, 8)  # 4 and 37 shingles: 4 - 4 + 1, and 37 - 30 + 8
    assert decontaminate.leaks(frame(docs), table.limit(0)).count() == 0
    assert decontaminate.leaks(frame([]), table).count() == 0


# -------------------------------------------------------------------------------------------- mixing


def test_rake_meets_targets(frame):
    rows = [(k, " ".join(prose(k, 5 + k % 40)), ("en", "fr", "de", None)[k % 4 % 3 if k % 5 else 3], f"s{k % 7}" if k % 3 else "hot") for k in range(400)]
    docs = frame(rows)
    cells = mixing.cells_of(docs).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    goal = {"lang": {"en": 0.5, "fr": 0.3, "de": 0.1, "unknown": 0.1}}
    got = mixing.rake(cells, goal).toPandas()
    for lang, share in goal["lang"].items():
        assert got[got.lang == lang].weight.sum() == pytest.approx(share, abs=1e-6)
    by_source = got.groupby("source").tokens.sum() / got.tokens.sum()
    want = by_source**mixing.TEMPER / (by_source**mixing.TEMPER).sum()
    assert np.allclose(got.groupby("source").weight.sum(), want, atol=1e-6)
    mixed = mixing.mix_to_targets(docs, goal, keep=0.5).toPandas()
    assert (mixed.n_tokens * mixed.probability).sum() == pytest.approx(0.5 * mixed.n_tokens.sum(), rel=1e-3)
    assert (mixed.kept == (mixed.draw < mixed.probability)).all()
    again = mixing.mix_to_targets(docs.repartition(7), goal, keep=0.5).toPandas()
    assert set(mixed[mixed.kept].doc_id) == set(again[again.kept].doc_id)


def test_rake_says_what_it_cannot_meet(frame):
    """Two English sources and a French one: the languages' shares follow from the sources'."""
    docs = frame([(k, " ".join(prose(k, 10 + k % 30)), ("en", "en", "fr")[k % 3], f"s{k % 3}") for k in range(60)])
    cells = mixing.cells_of(docs).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    got = mixing.rake(cells).toPandas()
    assert got.gap.nunique() == 1 and got.gap[0] > 1e-3
    with pytest.raises(ValueError, match="no weights meet"):
        mixing.rake(cells, {"lang": {"en": 0.1, "fr": 0.9}, "source": {"s0": 0.4, "s1": 0.4, "s2": 0.2}})
    agreed = mixing.rake(cells, {"lang": {"en": 0.6, "fr": 0.4}, "source": {"s0": 0.3, "s1": 0.3, "s2": 0.4}, "topic": {"prose": 1.0}}).toPandas()
    assert agreed.gap[0] <= 1e-9


def test_rake_equals_plain_raking(frame):
    """Against numpy over all odd rows; one margin given, two tempered."""
    rows = [(k, " ".join(prose(k, 5 + k % 40)), ("en", "fr", None)[k % 3 if k % 5 else 2], f"s{k % 4}") for k in range(200)] + [(None, None, None, None), (7, "", "xx", "s9")]
    cells = mixing.cells_of(frame(rows)).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    got = mixing.rake(cells, {"lang": {"en": 0.6, "fr": 0.4, "absent": 3.0}}).toPandas()
    weight = (got.tokens / got.tokens.sum()).to_numpy()
    targets = {}
    for m in mixing.MARGINS:
        share = got.tokens.groupby(got[m]).sum() / got.tokens.sum()
        t = share**mixing.TEMPER if m != "lang" else share * 0 + [{"en": 0.6, "fr": 0.4}.get(x, 0.0) for x in share.index]
        t[share == 0] = 0.0
        targets[m] = (t / t.sum()).loc[got[m]].to_numpy()
    for _ in range(400):
        for m in mixing.MARGINS:
            share = got.assign(w=weight).groupby(m).w.transform("sum").to_numpy()
            weight = np.where(share > 0, weight * targets[m] / np.where(share > 0, share, 1), 0.0)
    assert np.allclose(got.weight, weight, atol=1e-6)


def test_rake_of_targets_met_in_the_limit(spark):
    """The full margins force the one cell off the diagonal towards 0, at a falling pace."""
    cells = spark.createDataFrame([("a", "x", "t", 1), ("a", "y", "t", 1), ("b", "x", "t", 1)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}
    got = mixing.rake(cells, goal, most_rounds=24).toPandas().set_index(["source", "lang"])
    assert 0 < got.gap.iloc[0] < 0.03
    assert got.weight[("a", "x")] < 0.03 and got.weight[("a", "y")] == pytest.approx(0.5, abs=0.03)
    with pytest.raises(ValueError, match="no weights meet"):
        mixing.rake(cells, goal | {"lang": {"x": 0.4, "y": 0.6}})
    with pytest.raises(ValueError, match="no weights meet"):
        mixing.rake(cells, goal | {"source": {"a": 1.0, "b": 0.0}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}} | {"lang": {"x": 0.0, "y": 1.0}, "source": {"a": 0.5, "b": 0.5}})


def test_mixing_odd_rows(frame, odd_docs):
    assert mixing.mix_to_targets(frame(odd_docs)).count() == len(odd_docs)
    assert mixing.mix_to_targets(frame([])).count() == 0
    assert mixing.mix_to_targets(frame([(1, None, None, None)])).count() == 1


# -------------------------------------------------------------------------------------- LM scoring


def brute_scores(rows, target, size):
    words = [[w.lower() for w in re.findall(WORD, r[1] or "")] for r in rows]
    top = {w for w, _ in Counter(w for ws in words for w in ws).most_common(size)}
    known = [[w if w in top else "?" for w in ws] for ws in words]
    n_symbols = len(top) + 1

    def model(chosen):
        pairs, left, right = Counter(), Counter(), Counter()
        for ws in chosen:
            for v, w in zip(["^", *ws], ws, strict=False):
                pairs[v, w] += 1
                left[v] += 1
                right[w] += 1
        total = sum(right.values())

        def loss(v, w):
            rest = (0.25 * right[w] / total + 0.05 / n_symbols) / 0.3 if total else 1 / n_symbols
            return -math.log(0.7 * pairs[v, w] / left[v] + 0.3 * rest if left[v] else rest)

        return loss

    t, b = model([k for r, k in zip(rows, known, strict=True) if r[0] in target]), model(known)
    return [sum(t(v, w) - b(v, w) for v, w in zip(["^", *ws], ws, strict=False)) / len(ws) if ws else None for ws in known]


def test_lm_scores(frame, spark):
    rows = [(k, " ".join(f"w{min(int(x[1:]), 30)}" for x in prose(k, 3 + k % 50, 60)), "en", "a") for k in range(60)] + [(90, None, "en", "a"), (91, " ", "en", "a")]
    target = spark.createDataFrame([(k,) for k in range(0, 60, 3)] + [(0,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(frame(rows), target).collect()}
    for r, want in zip(rows, brute_scores(rows, set(range(0, 60, 3)), 31), strict=True):
        assert found[r[0]] is None if want is None else found[r[0]] == pytest.approx(want, abs=1e-4)


def test_lm_scores_tell_all_words_apart(frame, spark):
    """More words than the former bound of 2,047; chunks of few words, so that counts of many chunks are added up."""
    rows = [(k, " ".join(prose(k, 120, 3000)), "en", "a") for k in range(80)] + [(90, None, "en", "a")]
    target = spark.createDataFrame([(k,) for k in range(0, 80, 3)], "doc_id long")
    n = len({w for r in rows for w in (r[1] or "").split()})
    assert n > 2500
    found = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(frame(rows), target, chunk_words=1).collect()}
    for r, want in zip(rows, brute_scores(rows, set(range(0, 80, 3)), n), strict=True):
        assert found[r[0]] is None if want is None else found[r[0]] == pytest.approx(want, abs=1e-6)


def test_lm_odd_rows(frame, spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.cross_entropy_difference(frame(odd_docs), none).count() == len(odd_docs)
    assert lm_score.cross_entropy_difference(frame([]), none).count() == 0


# -------------------------------------------------------------------------------------------- WARC


def pages(spark):
    rows = [(5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, None), (8, "http://a/ x\r\ny", ""), (10, "u", "é" * 3000), (None, "n", "<p>same</p>"), (11, "v", "x"), (11, "v", "x")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, first string, size int"), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    bundles = warc.write_bundles(df.repartition(2), frame_bytes=2000)
    found = warc.read_bundles(bundles).collect()
    assert len(found) == len(rows)
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(least.get(html or "", page), page)
    html_of = {p: h or "" for p, _, h in rows}
    for r in found:
        body = html_of[r["page_id"]].encode()
        first = least[body.decode()]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("response" if r["page_id"] == first else "revisit")
        assert r["refers_to"] == (None if r["page_id"] == first else first)
        assert bytes(r["payload"]) == (body if r["record_type"] == "response" else b"")


def test_warc_seeks(spark):
    df, _ = pages(spark)
    for b in warc.write_bundles(df.coalesce(1), frame_bytes=400).collect():
        data = bytes(b["data"])
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        assert magic == 0x8F92EAB1 and n == len(warc.seek_table(data)) > 1 and flags == 0
        for e in b["index"]:
            record = warc.read_record(data, e["frame"], e["offset"], e["length"])
            assert e["record"] == f"urn:page:{'none' if record['page_id'] is None else record['page_id']}"


def test_warc_empty(spark):
    df, _ = pages(spark)
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_groups_with_hot_keys(spark, heavy):
    """A third of all rows under one key; a plain join gives the same rows, whichever groups are broadcast."""
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"k{k % 40}") for k in range(600)], "id long, key string")
    groups = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first"))
    found = join_groups(rows, groups, "key", "members", heavy)
    assert sorted(map(tuple, found.select("id", "first").collect())) == sorted(map(tuple, rows.join(groups, "key").select("id", "first").collect()))
    assert found.columns == ["key", "id", "first"] and join_groups(rows.limit(0), groups.limit(0), "key", "members").count() == 0


def test_warc_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(3, None, "abc"), (1, None, "abc"), (2, None, "abcd"), (4, None, "abcd"), (None, None, "abcd")], "page_id long, url string, html string")
    found = warc.read_bundles(warc.write_bundles(df, least_revisit_bytes=4), with_payload=False).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found} == {(1, "response", None), (3, "response", None), (2, "response", None), (4, "revisit", 2), (None, "revisit", 2)}


# -------------------------------------------------------------------------------------- language ID


def test_network_gradients():
    net = language_id.ByteNetwork(["a", "b", "c"], seed=1)
    draw = np.random.default_rng(0)
    windows, target = draw.integers(97, 110, (6, 20)).astype(np.uint8), draw.integers(0, 3, 6)
    _, slope = net.gradients(windows, target)
    for name in net.weights:
        w = net.weights[name] = net.weights[name].astype(np.float64)
        at = tuple(draw.integers(0, s) for s in w.shape) if name != "embed" else (int(windows[0, 5]), 3)
        old, step = w[at], 1e-5
        w[at] = old + step
        up, _ = net.gradients(windows, target)
        w[at] = old - step
        down, _ = net.gradients(windows, target)
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(slope[name][at], abs=2e-4)


def test_tables_give_the_same_probabilities():
    net = language_id.ByteNetwork(["a", "b"], seed=2)
    windows = np.random.default_rng(1).integers(0, 256, (5, 64)).astype(np.uint8)
    features, _ = net._pooled(windows)
    logits = features @ net.weights["out"] + net.weights["bias"]
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(language_id.probabilities(windows, net.tables()), want, atol=1e-5)


def test_language_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(frame, odd_docs):
    rows = {str(r["doc_id"]): r for r in language_id.identify(frame(odd_docs), epochs=1).collect()}
    assert {rows[k]["lang_pred"] for k in ("4", "5", "6")} == {"und"}
    assert language_id.identify(frame([])).count() == 0
    none = language_id.identify(frame([(1, "some text", None, None)])).collect()
    assert [r["lang_pred"] for r in none] == ["und"]


# ------------------------------------------------------------------------------------------ licenses


def test_licenses(frame):
    texts = dict(licenses.KNOWN)
    mit = texts["MIT"].replace("<year> <holders>", "1999 Someone, Inc.").upper().replace("SUBLICENSE", "SUB-LICENCE").replace('"', "“")
    rows = [
        (1, mit, "en", "a"), (2, texts["ISC"] + "\nmore", "en", "a"), (3, "  released UNDER the MIT licence ", "en", "a"), (4, None, None, None), (5, "", None, None),
        (6, "Copyright (c) 2001 Me", "en", "a"), (7, texts["BSD-3-Clause"].replace("\n", "\r\n"), "en", "a"), (8, texts["Zlib"], "en", "a"), (8, texts["Zlib"], "en", "a"),
    ]
    found = sorted((r["doc_id"], r["license_id"]) for r in licenses.scan(frame(rows)).collect() if r["license_id"])
    assert found == [(1, "MIT"), (3, "MIT-line"), (7, "BSD-3-Clause"), (8, "Zlib"), (8, "Zlib")]
    assert [r["digest"] for r in licenses.scan(frame(rows)).collect() if r["doc_id"] == 4] == [None]
    assert licenses.scan(frame([])).count() == 0


# ------------------------------------------------------------------------------------------ sharding


def test_shards(frame, odd_docs):
    rows = odd_docs + [(100 + k, f"text {k % 60} " * (1 + k % 9), "en", "a") for k in range(300)]
    found = sharding.shard(frame(rows)).collect()
    assert len(found) == len(rows)
    by_text, by_shard = defaultdict(set), defaultdict(list)
    text_of = {(r[0], zlib.crc32((r[1] or "").encode())): r[1] or "" for r in rows}
    for r in found:
        text = text_of[r["doc_id"], r["text_crc32"]]
        assert r["size"] == len(text.encode()) + 1
        by_text[text].add(r["shard"])
        by_shard[r["shard"]].append(r)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by_shard.values())
    sizes = Counter()
    for r in found:
        sizes[text_of[r["doc_id"], r["text_crc32"]]] += r["size"]
    total, largest = sum(sizes.values()), max(sizes.values())
    assert all(abs(sum(r["size"] for r in v) - total / 8) <= largest for v in by_shard.values())
    assert sharding.shard(frame([])).count() == 0


def test_shards_by_brute_force(frame, odd_docs):
    """Every row's shard and slot against prefix sums over a sorted list."""
    rows = odd_docs + [(k, "hot " * 9, "en", "a") for k in range(500, 650)] + [(100 + k, f"text {k % 60} " * (1 + k % 9), "en", "a") for k in range(300)] + [(None, "no id, own text", "en", "a")] * 2
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    order = sorted(groups, key=lambda t: ((least(groups[t]) is not None, least(groups[t]) or 0), hashlib.md5(t.encode()).digest()))
    size = lambda t: len(t.encode()) + 1
    total, at, slots, want = sum(size(r[1] or "") for r in rows), 0, Counter(), Counter()
    for t in order:
        held = size(t) * len(groups[t])
        shard = min(7, int((at + held / 2) * 8 // total))
        for i in sorted(groups[t], key=lambda i: (i is not None, i or 0)):
            want[i, size(t), zlib.crc32(t.encode()), shard, slots[shard]] += 1
            slots[shard] += 1
        at += held
    assert Counter(map(tuple, sharding.shard(frame(rows)).select("doc_id", "size", "text_crc32", "shard", "slot").collect())) == want


# ------------------------------------------------------------------------------------------ pipeline


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.stage(step(spark, before, data), "test")
        assert kept.columns == docs.columns
        assert kept.exceptAll(before).isEmpty(), name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert decontaminate.leaks(kept, spark.read.parquet(f"{data}/benchmark.parquet")).isEmpty()
    again = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(frame, odd_docs, spark, data, name):
    step = dict(corpus_pipeline.STAGES)[name]
    docs = frame(odd_docs).select(*corpus_pipeline.COLUMNS, "code", "key")
    assert step(spark, docs, data).count() <= len(odd_docs)
    assert step(spark, docs.limit(0), data).count() == 0
