import numpy as np
import pytest
from helpers import LOWER, ODD, components, docs_of, words

from stageloom.llm import setsketch as ss
from stageloom.llm import text as tx
from stageloom.llm.components import connected_components


def plain(rows, width, percent=80):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: k for k, i in enumerate(order)}
    links = [
        (place[i], place[j])
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    root = components(links, range(len(rows)))
    return [(rows[i][0], len(sets[i]), rows[order[root[place[i]]]][0]) for i in range(len(rows))]


def near(n_words, n_changed, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**9, n_words)]
    for k in range(n_changed):
        base[(k + 1) * n_words // (n_changed + 1)] = f"x{seed}{k}"
    return base


def corpus():
    """Groups of copies and of near copies around the threshold, and a chain whose ends are not alike."""
    rows, rng = [], np.random.default_rng(5)
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60 + 30 * g)]
        for _ in range(12):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(0, 5)), replace=False):
                copy[at] = f"y{rng.integers(10**9)}"
            rows.append(" ".join(copy))
    chain = [f"c{i}" for i in range(200)]
    rows += [" ".join(chain[k * 8 : k * 8 + 100]) for k in range(8)]
    rows += [rows[0]] * 5 + [rows[0].upper().replace("G0W", "g0w")]
    order = rng.permutation(len(rows))
    return [(int(order[i]) + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows_per_block", [400, 2])
def test_against_all_pairs(spark, monkeypatch, rows_per_block):
    """Also with open buckets cut into many blocks."""
    monkeypatch.setattr(ss, "ROWS_PER_BLOCK", rows_per_block)
    rows = corpus()
    got = ss.near_duplicates(docs_of(spark, rows, "node"), width=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain(rows, 4))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [r[:2] for r in ODD]
    got = ss.near_duplicates(docs_of(spark, rows, "n"), width=5).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(plain(rows, 5), key=key)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == want
    assert ss.near_duplicates(docs_of(spark, [])).collect() == []
    kept = ss.keep_one(docs_of(spark, ODD, "tag"))
    assert kept.columns == ["doc_id", "text", "tag"]
    texts = [r.text for r in kept.collect()]
    assert texts.count(ODD[0][1]) == 1 and len(texts) == len(ODD) - 1


def test_keep_one_of_each_group(spark):
    rows = corpus()
    kept = {r.doc_id for r in ss.keep_one(docs_of(spark, rows)).collect()}
    assert kept == {d for d, _, least in plain(rows, 5) if d == least}


def test_registers_agree_as_often_as_the_sets(spark):
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 1 << 63, 1300).astype(tx.U64))
    for common in (500, 900, 1100):
        a = pool[:1200]
        b = np.concatenate((pool[:common], tx.mix(pool[:1200 - common])))
        registers = ss.sketch([a, b], 2000)
        true = common / (2400 - common)
        size = np.array([1200.0])
        assert ss.estimate(registers[:1], registers[1:], size, size)[0] == pytest.approx(true, abs=0.05)
        whole = ss.sketch([np.unique(np.concatenate((a, b)))], 2000)[0]
        assert np.array_equal(ss.merge_sketches(registers[0], registers[1]), whole)


def test_sketch_does_not_depend_on_its_company():
    sets = [np.array([3], dtype=tx.U64), np.arange(1, 900, dtype=tx.U64), np.array([3, 9], dtype=tx.U64)]
    together = ss.sketch(sets)
    assert all(np.array_equal(ss.sketch([s])[0], row) for s, row in zip(sets, together, strict=True))
    assert ss.sketch([]).shape == (0, ss.REGISTERS)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (100, 15), (7, 7), (200, 201), (200, 201)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    nodes = {n for pair in links for n in pair} - set()
    want = components(links, nodes)
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in want.items()}
