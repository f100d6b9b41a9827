import hashlib

import numpy as np
import pytest
from helpers import ODD, docs_of, words
from pyspark.sql import functions as F

from stageloom.llm import members, repeats


def plain(rows, width):
    least = {}
    key = lambda d: (d is None, d or 0)
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            least[s] = min(least.get(s, key(doc_id)), key(doc_id))
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < key(doc_id):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def found(df):
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    passage = [[f"p{k}w{i}" for i in range(30)] for k in range(4)]
    out = []
    for d in range(80):
        w = [f"u{x}" for x in rng.integers(0, 400, int(rng.integers(0, 80)))]
        for k in rng.integers(0, 4, int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            cut = int(rng.integers(8, 31))
            w[at:at] = passage[k][:cut]
        out.append((d * 7 % 80, " ".join(w)))
    return [*out, out[11], (500, out[3][1]), (501, out[3][1])]


@pytest.mark.parametrize("width", [10, 1, 50])
def test_against_all_windows(spark, rows, width):
    assert found(repeats.remove_repeats(docs_of(spark, rows), width=width)) == plain(rows, width)


def test_many_ranges_and_small_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(repeats.repeated_intervals, "__defaults__", (10, 50, 500))
    docs = docs_of(spark, rows).repartition(5)
    docs.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/repeat-rows")
    assert found(repeats.remove_repeats(spark.read.parquet(path), width=10)) == plain(rows, 10)


def test_odd_rows(spark):
    plain_rows = [r[:2] for r in ODD]
    got = repeats.remove_repeats(docs_of(spark, ODD, "cuts"), width=3, keep_text=True)
    assert found(got) == plain(plain_rows, 3)
    assert repeats.remove_repeats(docs_of(spark, [])).collect() == []
    line = "word " * 200
    texts = {r.doc_id: r.kept_text for r in repeats.remove_repeats(docs_of(spark, [(1, line), (2, line + "own end")]), keep_text=True).collect()}
    assert texts == {1: line.strip(), 2: "own end"}


def test_bit_map_passes_all_members(spark):
    keys = spark.createDataFrame([(i * 7919**3,) for i in range(-500, 500)], "h long")
    rows = keys.unionByName(spark.createDataFrame([(None,), (12345,)], "h long")).withColumn("bits", F.lit(1))
    inside, outside = members.may_be_in(rows, keys, "h", "h")
    assert inside.columns == outside.columns == ["h", "bits"]
    assert members.marked(members.bit_map(keys, "h"), np.array([7919**3 * 7, 12345])).tolist() == [True, False]
    assert inside.count() == 1000 and {r.h for r in outside.collect()} == {None, 12345}
