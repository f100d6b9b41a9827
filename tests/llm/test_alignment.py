import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import ODD, docs_of

from stageloom.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Tokenizers disagree: where one cuts, the other goes on.", "Größe 漢字 und <|endoftext|> </s> <s> 12345", "a", " ", "  two  blanks ",
    "\u2581 is taken for a blank", "zero \0 byte", "🙂🙃 emoji\n\nlines\ttabs", "Tokenizers disagree: where one cuts, the other goes on.",
    "x" * 3000, "the the the the " * 50, "e\u0301 combining \ufb01 ligature \u00a0 blank", "",
]


@pytest.fixture(scope="module")
def plain():
    """Every token's interval, every pair of tokens compared, with the libraries alone."""
    vocabulary = json.load(open(A, encoding="utf-8"))["model"]["vocab"]
    a_text = {i: piece for piece, i in vocabulary.items()}
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in letters} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}
    left = tokenizers.Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        piece = right.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if len(piece) == 6 and piece[:3] == "<0x" else piece.replace("\u2581", " ").encode()

    def run(texts):
        rows, documents = [], Counter()
        for text in texts:
            a = left.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
            b = right.encode(text) if text else []
            a_parts, b_parts = [bytes(byte_of[c] for c in a_text[i]) for i in a], [b_bytes(i) for i in b]
            if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                rows.append(([], [], [], []))
                continue
            spans = []
            for parts in (a_parts, b_parts):
                ends = np.cumsum([len(p) for p in parts]).tolist()
                spans.append([set(range(e - len(p), e)) for p, e in zip(parts, ends, strict=True)])
            links = [(x, y) for x, s in zip(a, spans[0], strict=True) for y, t in zip(b, spans[1], strict=True) if s & t]
            cuts = sorted({max(s) for s in spans[0]} & {max(s) for s in spans[1]})
            groups = []
            for low, high in zip([-1, *cuts], cuts, strict=False):
                inside = [[str(i) for i, s in zip(ids, side, strict=True) if low < max(s) <= high] for ids, side in zip((a, b), spans, strict=True)]
                groups.append("|".join(",".join(part) for part in inside))
            documents.update(set(links))
            rows.append((a, b, groups, links))
        best = {}
        for (x, _), n in documents.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for a, b, groups, links in rows:
            text = ";".join(groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
            n_best = sum(documents[k] == best[k[0]] for k in links)
            out.append((len(a), len(b), len(groups), len(links), n_best, sum(documents[k] for k in links), digest, text))
        return out

    return run


def found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("known", [1 << 20, 7, 0])
def test_against_all_pairs_of_tokens(spark, plain, known):
    """Also with most counts from the join."""
    rows = list(enumerate(TEXTS))
    want = sorted(((i, *r[:7]) for (i, _), r in zip(rows, plain(TEXTS), strict=True)), key=str)
    got = found(al.align_documents(docs_of(spark, rows).repartition(3), A, B, known_pairs=known))
    assert got == want and sum(r[3] for r in got) > 100


def test_odd_rows_and_groups(spark, plain):
    rows = [r for r in ODD if r[0] not in (5, 6)] + [(5, "w" * 300, "z"), (6, "word " * 80, "z")]
    want = plain([r[1] for r in rows])
    got = al.align_documents(docs_of(spark, rows, "groups"), A, B, keep_groups=True)
    assert sorted(((r.doc_id, r.groups) for r in got.collect()), key=str) == sorted(((r[0], w[7]) for r, w in zip(rows, want, strict=True)), key=str)
    assert found(got) == sorted(((r[0], *w[:7]) for r, w in zip(rows, want, strict=True)), key=str)
    for r in got.collect():
        size = len((" " + (next(t for i, t, _ in rows if i == r.doc_id and (t or "") != "") or "")).encode()) if r.n_a and r.doc_id not in (7, None) else None
        assert len(r.group_ends) == r.n_groups and r.group_ends == sorted(r.group_ends)
        assert size is None or r.group_ends[-1] == size
    assert al.align_documents(docs_of(spark, []), A, B).collect() == []


def test_intervals():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        cuts = [np.unique(np.concatenate((rng.integers(1, n + 1, int(rng.integers(0, 20))), [n]))) for _ in range(2)]
        (a_end, a_start), (b_end, b_start) = ((c, np.concatenate(([0], c[:-1]))) for c in cuts)
        shared = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups = al.coalesce(a_start, a_end, b_start, b_end)
        assert [g.tolist() for g in groups] == [[sum(s < e for s in shared) for e in ends] for ends in (a_end, b_end)]
        pairs = list(zip(*(x.tolist() for x in al.overlaps(a_start, a_end, b_start, b_end)), strict=True))
        assert pairs == [(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    """Blanks of all kinds, contractions, signs of special tokens, a full table, long words, and words that do not come back."""
    import random

    monkeypatch.setattr(al, "WORDS_HELD", 300)
    rng, (a, b, _) = random.Random(7), al.sides(A, B)
    words = al.Words(a, b)
    assert al.known_words(A, B) is not None
    signs = [*"aé漢Ж1!🙂", " ", " ", " ", "\xa0", "　", " ", "​", "\x85", "\x1c", "\n", "\t", "'s", "▁", "́", "<s>", "<|endoftext|>", "y" * 70]
    texts = [t for t in ("".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(3000))] + [t for t in TEXTS if t]
    for start in range(0, len(texts), 400):
        some = texts[start : start + 400]
        wanted = [(" " + t).encode() for t in some]
        for side, (ids, counts, good) in zip((a, b), words.tokens(wanted), strict=True):
            want_ids, want_counts, want_good = side.tokens(some, wanted)
            assert (good == want_good).all() and (counts[good] == want_counts[good]).all()
            assert (ids[np.repeat(good, counts)] == want_ids[np.repeat(want_good, want_counts)]).all()
    assert len(words.slots) <= 300


def test_a_known_word_is_not_encoded_again(monkeypatch):
    a, b, _ = al.sides(A, B)
    words, seen = al.Words(a, b), []
    for side in (a, b):
        monkeypatch.setattr(side, "encode", lambda texts, encode=side.encode: seen.extend(texts) or encode(texts))
    for _ in range(3):
        words.tokens([b" one two three"] * 50)
    assert sum(map(len, seen)) <= 2 * len(" one two three")


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}])
def test_other_tokenizers_see_whole_texts(tmp_path, change):
    path = tmp_path / "other.json"
    path.write_text(json.dumps(json.load(open(A, encoding="utf-8")) | change), encoding="utf-8")
    assert not al.ByteLevel(str(path)).by_words and al.known_words(str(path), B) is None
