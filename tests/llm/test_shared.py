import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import near, shared

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÉé \t\n\x0b\x0c\r\x85\xa0İ"), max_size=12)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_words_of_slices(texts, skip):
    column = pa.array(texts, pa.string())[skip:]
    offsets, words = shared.split_words(column)
    found = [words.to_pylist()[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
    assert found == [brute.words(t) for t in texts[skip:]]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(0, 3), st.integers(1, 4))
def test_shingles_of_slices(texts, skip, length):
    sets = near.shingle_sets(pa.array(texts, pa.string())[skip:], length)
    assert [len(s) for s in sets] == [len(brute.shingles(t, length)) for t in texts[skip:]]


def test_lower_case_of_a_slice_of_long_texts():
    texts = [f"Wört{i} ABC " * 50 for i in range(100)]
    sets = near.shingle_sets(pa.array(texts)[60:], 3)
    low = near.shingle_sets(pa.array([t.replace("W", "w").replace("ABC", "abc") for t in texts])[60:], 3)
    assert all((a == b).all() for a, b in zip(sets, low))


def test_slices_are_bounded_and_whole():
    rows = pa.table({"t": ["a" * 10, None, "", "b" * 100, "c"], "n": range(5)})
    parts = list(shared.slices(rows, "t", 12))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1, 2], [3], [4]]
    assert list(shared.slices(rows.slice(0, 0), "t")) == []


def test_rolling_hashes_tell_windows_apart():
    words = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = shared.rolling(words, 8)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    assert len(set(keys.tolist())) == len(set(windows))
