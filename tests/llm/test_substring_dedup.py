import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import substring_dedup
from skylattice.llm.fm_index import FMIndex, suffix_array

from .conftest import prose


def brute(rows):
    """Rows of one doc_id are one document; rows without doc_id take no part."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for k in range(len(w) - 19):
                g = tuple(w[k : k + 20])
                first[g] = min(first.get(g, (r[0], k)), (r[0], k))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        if r[0] is not None:
            for k in range(len(w) - 19):
                if first[tuple(w[k : k + 20])] < (r[0], k):
                    gone |= set(range(k, k + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **how):
    rows = substring_dedup.deduplicate(df, **how).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    return sorted(map(tuple, rows.collect()), key=str)


def test_odd_rows(frame, odd_docs):
    assert run(frame(odd_docs)) == brute(odd_docs)


def test_empty_table(frame):
    assert run(frame([])) == []


def passages():
    """Passages that documents share, overlap in part, and repeat inside one document."""
    shared = [prose(k, 70, 300) for k in range(4)]
    rows = []
    for k in range(30):
        body = prose(500 + k, 15) + shared[k % 4][k % 7 :] + prose(600 + k, 12) + shared[(k + 1) % 4][: 60 - k]
        rows.append((k * 3 % 31, " ".join(body), "en", "a"))
    rows.append((99, " ".join(["tick"] * 90 + shared[0] + ["tick"] * 40), "en", "a"))
    return rows


def test_passages(frame):
    assert run(frame(passages())) == brute(passages())


@pytest.mark.parametrize("how", [{"shard_words": 200, "chunk_bytes": 700}, {"max_segments": 1, "chunk_bytes": 700}, {"max_segments": 3, "max_same": 2, "chunk_bytes": 500}])
def test_many_chunks_shards_and_hot_minimizers(frame, how):
    assert run(frame(passages()), **how) == brute(passages())


def test_odd_rows_in_many_chunks(frame, odd_docs):
    assert run(frame(odd_docs), max_segments=1, max_same=1 + 1, chunk_bytes=100) == brute(odd_docs)


def test_suffix_array():
    draw = np.random.default_rng(3)
    whole = np.append(draw.integers(1, 6, 400), 0)
    assert [tuple(whole[i:]) for i in suffix_array(whole)] == sorted(tuple(whole[i:]) for i in range(len(whole)))


def test_matching_statistics():
    draw = np.random.default_rng(3)
    text = draw.integers(1, 4, 300)
    index = FMIndex(text)
    end = np.arange(11, 300)
    length, low, high = index.matching_statistics(end, 8)
    times = lambda run: [j for j in range(301 - len(run)) if (text[j : j + len(run)] == run).all()]
    for e, n, a, b in zip(end, length, low, high, strict=True):
        assert n == max(k for k in range(9) if k == 0 or len(times(text[e - k + 1 : e + 1])) > 1)
        assert b - a == len(times(text[e - n + 1 : e + 1]))
    full = np.flatnonzero(length == 8)
    least = index.earliest(low[full], high[full], np.append(np.arange(300), 10**9))
    assert least.tolist() == [times(text[e - 7 : e + 1])[0] for e in end[full]]
