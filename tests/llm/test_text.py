import numpy as np
import pyarrow as pa
from helpers import LOWER, words
from hypothesis import given, settings
from hypothesis import strategies as st

from stageloom.llm import text as tx

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é漢\n\t\x0b\x1f\u00a0", max_size=30)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_runs_between_the_six_blank_bytes(texts):
    data, offsets = tx.raw(pa.array(["lead", *texts], pa.string()).slice(1))
    starts, ends, first = tx.words(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [found[first[i] : first[i + 1]] for i in range(len(texts))] == [words(t) for t in texts]
    hashes = tx.word_hashes(data, starts, ends, lower=True)
    by_word = {}
    for word, value in zip(found, hashes.tolist(), strict=True):
        assert by_word.setdefault(word.translate(LOWER), value) == value
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=8), st.integers(1, 4))
def test_window_starts(sizes, width):
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    want = [int(first[i]) + k for i, n in enumerate(sizes) for k in range(n - width + 1)]
    assert tx.window_starts(first, width).tolist() == want


def test_equal_windows_have_equal_hashes_wherever_they_lie():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 300).astype(tx.U64) + tx.U64(11)
    at = np.arange(297)
    hashes = tx.spans_hash(codes, at, at + 3)
    by = {}
    for i in at:
        key = tuple(codes[i : i + 3].tolist())
        assert by.setdefault(key, hashes[i]) == hashes[i]
    assert len(set(by.values())) == len(by)


def test_summed_and_distinct():
    values, counts = tx.distinct(np.array([3, 1, 3, 3], dtype=tx.U64))
    assert values.tolist() == [1, 3] and counts.tolist() == [1, 3]
    values, counts = tx.summed(np.array([5, 2, 5], dtype=tx.U64), np.array([1, 2, 3]))
    assert values.tolist() == [2, 5] and counts.tolist() == [2, 4]
    assert len(tx.distinct(values[:0])[0]) == 0


def test_runs_cover_all_rows():
    sizes = np.array([5, 1, 1, 100, 0, 3])
    assert list(tx.runs(sizes, 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
