import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import words as W
from sparkloom.llm.substring import sliding_argmin

from .helpers import words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1c 日", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_words_of_rows(texts):
    data, offsets = W.text_buffers(pa.array(texts, pa.string()))
    w = W.split_words(data, offsets)
    for r, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
        assert got == words(t) == w.joined(r).decode().split(" ")[: len(got)]
    h = w.hashes()
    flat = [x for t in texts for x in words(t)]
    assert len({int(x): y for x, y in zip(h, flat, strict=True)}) == len(set(flat))
    ok = W.inside(w.first, 3)
    row = w.row
    assert [bool(x) for x in ok] == [bool(row[i] == row[i + 2]) for i in range(len(ok))]
    wins = W.windows(h, 3)
    assert len({tuple(flat[i : i + 3]) for i in range(len(wins))}) == len(set(wins.tolist()))


def test_lower_and_sliced_columns():
    col = pa.array(["x", "Abc É", None, "aBC É"]).slice(1)
    w = W.split_words(*W.text_buffers(col))
    h = w.hashes(lower=True)
    assert h[0] == h[2] and h[1] == h[3] and w.hashes()[0] != w.hashes()[2]
    assert len(W.split_words(*W.text_buffers(pa.array(["It's, a-b 1"])), alnum=True).start) == 5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 8))
def test_sliding_argmin(values, w):
    g = np.array(values, np.uint64)
    if len(g) >= w:
        got = sliding_argmin(g, w)
        assert got.tolist() == [i + int(np.argmin(g[i : i + w])) for i in range(len(g) - w + 1)]


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_slices_cover_all_rows(most):
    col = pa.array(["abc", None, "", "é" * 9, "x"])
    assert [r for a, b, _, _ in W.slices(col, most) for r in range(a, b)] == list(range(5))
    assert b"".join(d.tobytes() for _, _, d, _ in W.slices(col, most)).decode() == "abc" + "é" * 9 + "x"
