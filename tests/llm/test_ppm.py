import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, ODD, docs_of, words
from pyspark.sql import functions as F

from stageloom.llm import ppm


def held():
    return F.col("doc_id") % 3 == 0



def plain(rows):
    """Base and trie scores of (doc_id, text) rows by dictionaries."""
    tokens = [words((t or "").translate(LOWER)) for _, t in rows]
    train = [w for (d, _), w in zip(rows, tokens, strict=True) if d is None or d % 3]
    counts, contexts = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    stream = lambda w: [ppm.BEFORE] * ppm.ORDER + list(" ".join(w).encode()) + [ppm.END]
    for w in train:
        counts.update(w)
        s = stream(w)
        for i in range(ppm.ORDER, len(s)):
            for o in range(ppm.ORDER + 1):
                contexts[o][tuple(s[i - o : i])][s[i]] += 1
    n = sum(counts.values()) + len(train)
    v = len(counts) + (1 if train else 0)

    def symbol(history, byte):
        out, gone = 0.0, set()
        for o in range(ppm.ORDER, -1, -1):
            seen = contexts[o].get(tuple(history[len(history) - o :]))
            if not seen:
                continue
            live = {x: c for x, c in seen.items() if x not in gone}
            total = sum(live.values())
            if byte in live:
                return out + math.log10((live[byte] - 0.5) / total)
            if live:
                out += math.log10(0.5 * len(live) / total)
            gone |= set(seen)
        return out - math.log10(max(1, ppm.SYMBOLS - len(contexts[0].get((), ()))))

    out = []
    for w in tokens:
        s = stream(w)
        score = sum(symbol(s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s)))
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[x] for x in w), len(train)])
        known = sum(counts[x] > 0 for x in w) + (1 if train else 0)
        out.append((len(w) + 1, known, n, base, score))
    return out


def check(spark, rows, **options):
    docs = docs_of(spark, [(*r[:2], "c") for r in rows], "score")
    got = ppm.score_documents(docs, held(), **options).collect()
    assert len(got) == len(rows)
    form = lambda r: (-1 if r[0] is None else r[0], *[round(float(x), 6) for x in r[1:]])
    found = sorted(form((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got)
    want = sorted(form((d, *p)) for (d, _), p in zip([r[:2] for r in rows], plain([r[:2] for r in rows]), strict=True))
    for a, b in zip(found, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5)
    return got


ROWS = [(i, f"The {'quick ' * (i % 4)}brown fox{i % 5} jumps\tover é {i * i % 7} dogs") for i in range(30)]


def test_against_dictionaries(spark):
    got = check(spark, ROWS, hot_words=5)
    assert {r.doc_id for r in got if r.held_out} == {d for d, _ in ROWS if d % 3 == 0}


def test_slices_give_the_same_scores(spark):
    assert len(ppm.slices([(5 << 8, 40), (6 << 8, 30), (9 << 8, 100)], 60)) == 3
    check(spark, ROWS, grams_per_slice=400, hot_words=3)


def test_odd_rows(spark):
    check(spark, [r[:2] for r in ODD if not r[1] or len(r[1]) < 1000] + ROWS[:6])
    assert ppm.score_documents(docs_of(spark, []), held()).collect() == []
    nothing = ppm.score_documents(docs_of(spark, [(0, "ab")]), held()).first()
    assert nothing.score == pytest.approx(-3 * math.log10(256)) and nothing.n_known == 0


def test_table_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000)).astype(np.uint64)
    table = ppm.Table(keys[::2], np.arange(len(keys[::2]), dtype=float))
    values, known = table.find(keys)
    assert known.tolist() == [i % 2 == 0 for i in range(len(keys))]
    assert values[known].tolist() == list(range(len(keys[::2])))


def test_remainder_is_the_crc_of_the_id(spark):
    from stageloom.llm.queries import remainder

    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", remainder(10).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 10 for r in rows)
