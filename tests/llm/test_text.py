import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortmill.llm.text import gathered, shingle_sets, slices, strings, text_bytes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t中", max_size=30)), max_size=8))
def test_words_match_the_pattern(texts):
    data, off = text_bytes(pa.array(texts, pa.string()))
    start, end, doc, h = words(data, off)
    expected = [(i, lower(w)) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert list(zip(doc.tolist(), strings(data, start, end).to_pylist())) == expected
    for (i, a), x in zip(expected, h):
        assert all((a == b) == (x == y) for (_, b), y in zip(expected, h))


def test_shingles_of_short_and_empty_texts():
    texts = pa.array(["a b c d e f a b c d e", "a b", "b a", None, " ", "a b"])
    _, _, doc, h = words(*text_bytes(texts))
    values, bounds = shingle_sets(h, doc, 6)
    assert np.diff(bounds).tolist() == [6, 1, 1, 0, 0, 1]
    assert values[bounds[1]] == values[bounds[5]] != values[bounds[2]]


def test_slices_keep_every_row():
    rng = random.Random(3)
    texts = ["x" * rng.choice([0, 10, 5000]) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    cut = list(slices(iter([batch]), size=4000))
    assert [t for b in cut for t in b.column(0).to_pylist()] == texts and len(cut) > 10


def test_gathered_batches_keep_all_rows_in_order():
    rows = [None, "", "a", "bcd" * 40, "e", "f" * 500, ""] * 9
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 5], pa.string())], ["word"]) for i in range(0, len(rows), 5)]
    got = list(gathered(iter([batches[0].slice(0, 0), *batches]), "word", 200))
    assert [x for b in got for x in b.column(0).to_pylist()] == rows
    assert 1 < len(got) < len(rows) and not list(gathered(iter([]), "word"))
