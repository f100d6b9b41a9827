import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import ODD, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from stageloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_perfect_hash_is_minimal(coder):
    slots = coder.hash.candidates(bpe.hash_pieces(coder.tokens))
    assert np.array_equal(slots, np.arange(len(coder.tokens)))
    assert np.array_equal(np.sort(coder.hash.slot_key), np.arange(len(coder.tokens)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(coder, library, text):
    packed = coder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(packed) == text.encode()


def test_every_code_point_as_the_library(coder, library):
    """Each code point after a letter, a digit and a blank: whether it goes on with them depends on its class alone."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{c}1{c} {c}\n" for c in points[at : at + 4000])
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), hex(ord(points[at]))


def test_full_tables_and_long_texts_change_nothing(coder, library, monkeypatch):
    texts = [f"Wörter {i} nnnnnnnnnn<|endoftext|>  \n don't" * 40 for i in range(30)]
    want = [library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "KEPT_RESULTS", 20)
    assert [np.frombuffer(p, "<u4").tolist() for t in texts for p in coder.encode_many([t])] == want
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode_many(texts)] == want


def test_unknown_id(coder):
    with pytest.raises(KeyError):
        coder.decode(np.array([60_000], dtype="<u4").tobytes())


def test_rows(spark, library):
    got = bpe.encode_documents(docs_of(spark, ODD, "n_tokens"), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    by_text = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, _ in ODD}
    for r in got:
        text = by_text[r.decoded_sha256]
        ids = library.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(docs_of(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
