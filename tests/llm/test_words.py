import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.common import Words, slices

TEXT = st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\rÀß 漢", max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 3))
def test_words_and_codes(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    words = Words(column)
    found = [[] for _ in column]
    codes = {}
    for row, a, b, code in zip(words.row, words.start, words.end, words.code, strict=True):
        word = bytes(words.data[a:b]).decode()
        found[row].append(word)
        assert codes.setdefault(word, code) == code
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in column.to_pylist()]
    assert len(set(codes.values())) == len(codes)


def test_grams_stay_in_rows():
    words = Words(pa.array(["a b c", "d", None, "a b c d"]))
    at, codes = words.grams(3)
    assert words.row[at].tolist() == [0, 3, 3]
    assert codes[0] == codes[1] != codes[2]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * k for k in range(50)] + [None]})
    parts = list(slices(iter([batch]), "text", 100))
    assert len(parts) > 5
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
