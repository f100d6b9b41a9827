import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stageloom.llm import hard_negatives as hn

DDL = "vec_id long, embedding array<float>, label int, `anchor` string"


def plain(rows, positives=5, negatives=10, step=100):
    """Every anchor against every row."""
    kept = {}
    for vec_id, vector, label, *_ in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        kept[(vec_id, label, v)] = None
    out, anchors = [], {}
    for vec_id, label, v in sorted(kept):
        if vec_id % step == 0:
            anchors.setdefault(vec_id, (label, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, lab) for i, lab, w in kept)
        best = [(i, -s) for s, i, lab in scored if lab == label and i != a][:positives]
        for p, ps in best:
            fits = [(i, -s) for s, i, lab in scored if lab != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 0.4, (6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] + rng.normal(0, 0.15, 8)
        rows.append((i, [float(x) for x in v.astype("float32")], int(rng.integers(0, 3)), "c"))
    same = rows[5][1]
    rows += [(1000 + i, same, i % 3, "c") for i in range(60)]  # a third of the rows around one cell, with ties
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("per_cell, block, first, asked", [(1024, 4096, 8192, 512), (8, 7, 5, 2)])
def test_against_all_rows(spark, monkeypatch, vectors, per_cell, block, first, asked):
    """Also with many cells, cells cut into blocks and rounds of few rows."""
    for name, value in (("ROWS_PER_CELL", per_cell), ("BLOCK_ROWS", block), ("FIRST_ROWS", first), ("ANCHORS_PER_BLOCK", asked)):
        monkeypatch.setattr(hn, name, value)
    got = found(hn.mine(spark.createDataFrame(vectors, DDL)))
    assert got == plain(vectors) and len(got) > 50


def test_heap_gives_all_cells_by_falling_bounds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 50, (300, 6))
    books = hn._fit(x[:, :3], 5), hn._fit(x[:, 3:], 4)
    near = [hn._nearest(x[:, :3], books[0]), hn._nearest(x[:, 3:], books[1])]
    radii = tuple(np.array([d[a == k].max(initial=0) for k in range(len(b))]) for (a, d), b in zip(near, books, strict=True))
    cell = near[0][0] * len(books[1]) + near[1][0]
    sizes = np.bincount(cell, minlength=20)
    index = hn.Index(books, radii, sizes, sizes, True)
    q = rng.normal(0, 50, 6)
    order = list(hn.cells_by_bound(q, index))
    bounds = dict((c, b) for b, c in order)
    assert sorted(bounds) == list(range(20)) and [b for b, _ in order] == sorted(bounds.values(), reverse=True)
    assert all(x[i] @ q <= bounds[cell[i]] for i in range(300))
    cells, seen = hn.next_cells(q, index, 3, order[10][0], 10**6)
    assert seen == 11 and cells == [c for _, c in order[3:11] if sizes[c]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5, 0.25, 0.0], 1, "x"), (0, [1.0, 0.5, 0.25, 0.0], 1, "repeated"), (0, [0.5, 0.5, 0.5, 0.5], 2, "same id"),
        (1, [1.0, 0.5], 1, "short"), (2, [0.9, 0.5, 0.1, 0.0], 1, "y"), (3, [0.4, 0.4, 0.1, 0.0], 2, "z"), (4, [0.4, 0.4, 0.1, 0.0], 3, "tie"),
        (5, [nan, 1.0, 1.0, 1.0], 2, "n"), (6, [inf, 1.0, 1.0, 1.0], 2, "n"), (7, [None, 1.0, 1.0, 1.0], 2, "n"), (8, None, 2, "n"),
        (9, [1.0, 1.0, 1.0, 1.0], None, "n"), (None, [1.0, 1.0, 1.0, 1.0], 2, "n"), (100, [-1.0, -1.0, 0.0, 0.0], 9, "alone"), (200, [], 4, "empty"),
    ]
    assert found(hn.mine(spark.createDataFrame(rows, DDL))) == plain(rows)
    assert hn.mine(spark.createDataFrame([], DDL)).collect() == []
    assert hn.mine(spark.createDataFrame(rows[5:7], DDL), is_anchor=F.col("id") < 0).collect() == []


def test_large_components_score_exactly(spark):
    rows = [(100 * k if k < 2 else k, [float(2.0**20 + k), float(2.0**19 - k), 3.0], k % 2, "c") for k in range(12)]
    assert found(hn.mine(spark.createDataFrame(rows, DDL))) == plain(rows)
    with pytest.raises(Exception, match="OverflowError|too large"):
        hn.mine(spark.createDataFrame([(0, [1e30, 1.0], 1, "c"), (1, [1e30, 1.0], 1, "c")], DDL)).collect()


def test_the_driver_gets_neither_a_table_nor_a_sample_of_every_partition(spark, monkeypatch, plan_of, vectors):
    """What it gets must not grow with rows or partitions: no broadcast but that of a row per cell, and no sorted limit."""
    stored, collected, frame, materialise, fit = {}, [], type(spark.range(1)), hn.materialise, hn._fit
    sizes = []

    def record(df, label):
        stored.setdefault(label, []).append(plan_of(df))
        return materialise(df, label)

    for name in ("toPandas", "toArrow"):
        def collect(df, run=getattr(frame, name)):
            collected.append(plan_of(df))
            return run(df)

        monkeypatch.setattr(frame, name, collect)
    monkeypatch.setattr(hn, "materialise", record)
    monkeypatch.setattr(hn, "_fit", lambda sample, k: sizes.append(len(sample)) or fit(sample, k))
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 100)
    out = hn.mine(spark.createDataFrame(vectors, DDL).repartition(6))
    stored["out"] = [plan_of(out)]
    assert found(out) == plain(vectors)
    assert not any("TakeOrdered" in plan for plan in collected) and all(50 <= n <= 150 for n in sizes) and len(sizes) == 2
    assert [label for label, plans in stored.items() if any("Broadcast" in plan for plan in plans)] == ["vector-blocks"]
