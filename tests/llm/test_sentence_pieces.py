import hashlib
import random

import pytest

from skylattice.llm import sentence_pieces as sp

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\tb\n\nc", "▁x", "x▁y", "▁▁▁", "\0", "a\0b", "é", "ﬁ Å ½", "𝒳 🙂", "<s>", "</s> <unk>", "<0x41>", "é", "​", "\xa0 x", "a\r\nb",
    " " * 100 + "end", "x" * 5000, "ab" * 3000 + " " * 40, "日本語のテキスト", "Ünï çödé – ﬁn x", "aaaaaaa bbbbbbb " * 20, "private",
]


@pytest.fixture(scope="module")
def model():
    return sp.read_model()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_single_texts_equal_the_library(model, library):
    pieces = sp.Pieces(model)
    draw = random.Random(5)
    letters = "aabcdeeeitn  \n\t.,▁éß日本🙂<>0123'\"()="
    texts = [x or "" for x in ODD] + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = pieces.encode(text)
        assert ids == library.encode(text), text
        assert pieces.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(model, library):
    pieces = sp.Pieces(model)
    draw = random.Random(6)
    pools = [range(0, 300), range(3, 259), range(259, 32000), [0, 1, 2, 28705, 259, 260, 264, 198, 172]]
    for _ in range(4000):
        ids = [draw.choice(draw.choice(pools)) for _ in range(draw.randrange(8))]
        assert pieces.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        pieces.decode([32000])


def test_rows(spark, frame, odd_docs, model, library):
    rows = odd_docs + [(100 + k, x, "en", "a") for k, x in enumerate(ODD)]
    made = sp.decode(sp.encode(frame(rows), model, check=True), model, check=True).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in made) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in made) == sorted((str(i), library.encode(t or "")) for i, t, *_ in rows)
    assert all(r["agrees"] and r["decoded_agrees"] for r in made)
    assert sp.encode(frame([]), model).count() == 0


def test_given_ids(spark, model, library):
    given = spark.createDataFrame([(1, [264, None, 287]), (2, None), (3, [])], "x int, ids array<int>")
    found = {r["x"]: r["decoded"] for r in sp.decode(given, model).collect()}
    assert found == {1: library.decode([264, 287]), 2: "", 3: ""}


def test_heap_and_arrays_agree(model, library, monkeypatch):
    draw = random.Random(7)
    texts = ["".join(draw.choice("aeiorstn ▁é.") for _ in range(draw.randrange(200))) for _ in range(300)] + [x or "" for x in ODD]
    want = library.encode(texts)
    for longest in (0, 3, 40, 10**6):
        monkeypatch.setattr(sp, "SIDE_BY_SIDE", longest)
        offsets, ids = sp.Pieces(model).encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_codes_that_collide(model, library, monkeypatch):
    monkeypatch.setattr(sp, "mix", lambda x: x * 0)
    texts = ["one two three two", "four", "", "one"]
    offsets, ids = sp.Pieces(model).encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == library.encode(texts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        sp.Pieces(b"")


def test_query(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) for r in sp.op11_sentence_pieces(spark, data).collect())
    want = []
    for r in docs:
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))), True))
    assert got == sorted(want)
