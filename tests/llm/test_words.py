import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cadence.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\f\r é😀\x00", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    data, at = W.utf8(pa.array(texts, pa.string()))
    w = W.words(data, at)
    got = [[data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first, w.first[1:], strict=False)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h = W.word_hash(w).tolist()
    flat = [x for t in got for x in t]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    for k in (1, 2, 3):
        starts, n = W.run_starts(w, k).tolist(), 0
        for i, j in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
            assert starts[n : n + max(0, j - i - k + 1)] == list(range(i, j - k + 1))
            n += max(0, j - i - k + 1)
        assert n == len(starts)


def test_slices_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 500, "c"])], names=["text"])
    parts = list(W.slices(b, most=60))
    assert sum(p.num_rows for p in parts) == 5 and pa.Table.from_batches(parts).column(0).to_pylist() == b.column(0).to_pylist()
    assert np.array_equal(W.utf8(b.slice(3, 2).column(0))[1], [0, 500, 501])
