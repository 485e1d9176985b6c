import hashlib

import numpy as np
import pytest

from skylattice.llm import fill_in_middle as fim


def brute(doc_id, text, seed="1", cut=90, spm=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    p, s, m = marks
    if h4 % 100 < spm:
        return doc_id, n, "spm", x, y - x, s + text[y:] + p + text[:x] + m + text[x:y]
    return doc_id, n, "psm", x, y - x, p + text[:x] + s + text[y:] + m + text[x:y]


TEXTS = ["é", "🙂", "a🙂b", "日本語" * 50, "x" * 1000, "<", "<<", "P>", "<S", "a<P>b", "<M>", "<S>", "mixed é日🙂 " * 400, "\0", "é" * 9, "<<<PPP>>>" * 5]


def rows_of(odd_docs):
    return odd_docs + [(1000 + 50 * k + i, t, "en", "a") for k, t in enumerate(TEXTS) for i in range(30)]


def key(row):
    return tuple(map(str, row))


def test_rows(frame, odd_docs):
    rows = rows_of(odd_docs)
    made = fim.restore(fim.fill_in_middle(frame(rows))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in made) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(frame([]))).count() == 0


def test_other_parameters(frame, odd_docs):
    rows, marks = rows_of(odd_docs), ("⟨pre⟩", "¹suf", "²mid")
    made = fim.restore(fim.fill_in_middle(frame(rows), "s", 50, 60, marks), marks).collect()
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((brute(i, t, "s", 50, 60, marks) for i, t, *_ in rows), key=key)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in made) == sorted((str(i), t or "") for i, t, *_ in rows)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P>", "<M>")])
def test_ambiguous_sentinels_are_refused(frame, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(frame([]), sentinels=marks)


def test_index_holds_exceptions_only():
    text = "ab é日🙂x" * 7
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.CodePoints(data)
    assert len(index.byte) == sum(ord(c) > 127 for c in text) == 21
    points = np.arange(len(text) + 1)
    want = [len(text[:k].encode()) for k in points]
    assert index.to_bytes(points).tolist() == want
    assert index.to_points(np.array(want)).tolist() == points.tolist()
    plain = fim.CodePoints(np.frombuffer(b"plain", np.uint8))
    assert len(plain.byte) == 0 and plain.to_bytes(np.arange(6)).tolist() == list(range(6))


def test_restores_given_outputs(spark):
    given = spark.createDataFrame([("psm", "<P>a<S>c<M>b"), ("spm", "<S>c<P>a<M>b"), ("plain", "<P>"), ("psm", "<P><S><M>"), ("plain", None)], "form string, output string")
    assert [r["restored"] for r in fim.restore(given).collect()] == ["abc", "abc", "<P>", "", ""]
