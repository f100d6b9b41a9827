import numpy as np
from helpers import LOWER, ODD, docs_of, words

from stageloom.llm import decontam as dc

STRIP = str.maketrans({chr(c): None for c in range(33, 127) if not chr(c).isalnum()})


def plain(docs, items):
    norm = lambda t: words((t or "").translate(LOWER).translate(STRIP))
    out = set()
    for doc_id, text in docs:
        w = norm(text)
        for item_id, item in items:
            x = norm(item)
            span = min(len(x), dc.SPAN)
            if span < dc.LEAST_WORDS:
                continue
            least = span - (dc.MOST_DIFFERENT if span == dc.SPAN else 0)
            places = [
                i
                for i in range(len(w) - span + 1)
                for j in range(len(x) - span + 1)
                if sum(w[i + k] == x[j + k] for k in range(span)) >= least
            ]
            if places:
                out.add((doc_id, item_id, len(set(places)), min(places), max(places) + span - 1))
    return out


def test_masks_ignore_every_pair():
    for a in range(dc.SPAN):
        for b in range(a):
            assert any(a not in m and b not in m for m in dc.MASKS)


def corpus():
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"t{x}" for x in rng.integers(0, 5000, n))) for i, n in enumerate((40, 12, 10, 9, 5, 4, 1))]
    items += [(20, None), (21, ""), (0, items[0][1])]
    docs = []
    for d in range(60):
        w = [f"t{x}" for x in rng.integers(0, 5000, int(rng.integers(0, 60)))]
        x = items[int(rng.integers(0, 6))][1].split()
        for at in rng.choice(len(x), int(rng.integers(0, min(5, len(x)))), replace=False):
            x[at] = "other"
        if d % 3:
            k = int(rng.integers(0, len(w) + 1))
            w[k:k] = x
        docs.append((d, " ".join(w).replace("t1", "T1,") if d % 2 else " ".join(w)))
    return docs, items


def test_against_all_alignments(spark):
    docs, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = dc.overlaps(docs_of(spark, docs, "seed"), table).collect()
    assert {(r.doc_id, r.item_id, r.n_windows, r.first_word, r.last_word) for r in got} == plain(docs, items)
    assert len(got) > 15 and all(0 < r.item_share <= 1 for r in got)
    clean = {r.doc_id for r in dc.without_overlaps(docs_of(spark, docs), table).collect()}
    assert clean == {d for d, _ in docs} - {r.doc_id for r in got}


def test_odd_rows(spark):
    table = spark.createDataFrame([(1, "the same words again and again and again")], "item_id long, text string")
    docs = docs_of(spark, ODD, "hit_tag")
    kept = dc.without_overlaps(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 2
    assert dc.overlaps(docs_of(spark, []), table).count() == 0
    assert dc.overlaps(docs, table.limit(0)).count() == 0
    assert dc.without_overlaps(docs, table.limit(0)).count() == len(ODD)


def test_short_items(spark):
    items = [(1, "one two three four five six seven"), (2, "a b c d e"), (3, "Paris"), (4, "Yes, it is."), (5, "巴黎是法国的首都"), (6, "東京"), (7, "p q r s t u v w x")]
    docs = [
        "x one two OTHER four five six seven y",
        "x one OTHER three four five OTHER seven y",
        "z, a b c d e z",
        "z a b X d e z",
        "He went to Paris with her",
        "Where to? Paris! Or not",
        "first line\nparis\nlast",
        "yes it is",
        'She said: "No. Yes, it is." Then',
        "yes it is not",
        "我知道巴黎是法兰的首都。对",
        "首都。東京。対",
        "東京に行く",
        "one two\nthree four five six seven",
        "3.Paris.4",
        "o p q r s t u v w y",
        "",
    ]
    want = {(0, 1), (2, 2), (3, 2), (5, 3), (6, 3), (7, 4), (8, 4), (10, 5), (11, 6), (13, 1), (15, 7)}
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [*enumerate(docs), (99, None)])
    got = dc.overlaps(docs, table, short_items=True).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.item_share == 1 for r in got)
    kept = {r.doc_id for r in dc.without_overlaps(docs, table, short_items=True).collect()}
    assert kept == {*range(17), 99} - {d for d, _ in want}


def test_short_items_leave_long_ones_as_they_are(spark):
    docs, items = corpus()
    table = spark.createDataFrame([i for i in items if len((i[1] or "").split()) >= dc.SPAN], "item_id long, text string")
    got = dc.overlaps(docs_of(spark, docs, "seed"), table, short_items=True).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in dc.overlaps(docs_of(spark, docs, "seed"), table).collect()} and got
