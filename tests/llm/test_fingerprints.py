import hashlib

import pytest
from helpers import ODD, docs_of

from stageloom.llm import fingerprints as fp


def phrases(text):
    seen, i = {}, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in seen:
            j += 1
        if j > len(text):
            break
        seen[text[i:j]] = None
        i = j
    return list(seen)


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaaaa", "abababababab", "the cat and the hat and the cat", "é漢" * 9])
def test_parse(text):
    seen = {}
    rest = fp.parse(text, seen)
    assert list(seen) == phrases(text)
    assert "".join(seen) + rest == text


def test_likeness_is_exact_for_small_sets():
    a, b = "the cat sat on the mat " * 3, "the cat sat on the hat " * 3
    x, y = set(phrases(a)), set(phrases(b))
    assert fp.likeness(fp.fingerprint_text(a), fp.fingerprint_text(b)) == pytest.approx(len(x & y) / len(x | y))
    assert fp.likeness(fp.fingerprint_text(""), fp.fingerprint_text("")) == 1
    assert fp.likeness(fp.fingerprint_text("a"), fp.fingerprint_text("")) == 0


def test_edits_follow_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_BLOCK", 7)
    rows = [(i * 37 % 101 * 10**12, f"text number {i} " * (i % 9 + 1) + "é漢"[: i % 3]) for i in range(60)]
    docs = docs_of(spark, rows, "block")
    assert fp.in_blocks(docs.select("doc_id", "text"), 7).select("block").distinct().count() > 5
    monkeypatch.setattr(fp.in_blocks, "__defaults__", (7,))
    got = {r.doc_id: r for r in fp.fingerprint_edits(docs).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine, other, after = (fp.fingerprint_text(t) for t in (text, edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (fp.encoded(mine), fp.encoded(other))
        assert (r.near_edited, r.near_next) == (fp.likeness(mine, other), fp.likeness(mine, after))


def test_odd_rows(spark):
    got = fp.fingerprint_edits(docs_of(spark, ODD, "own")).collect()
    assert len(got) == len(ODD)
    same = {r.fingerprint for r in got if r.doc_id == 7 and r.n_chars == 40}
    assert len(same) == 1
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert fp.fingerprint_edits(docs_of(spark, [])).collect() == []
    lone = fp.fingerprint_edits(docs_of(spark, [(1, "abc")])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and lone.near_next == 1
    assert fp.fingerprints(docs_of(spark, ODD)).count() == len(ODD)
