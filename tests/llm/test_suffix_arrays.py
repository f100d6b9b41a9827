import hashlib

import numpy as np
import pytest
from helpers import ODD, docs_of

from stageloom.llm import suffix_arrays as sa
from stageloom.llm import text as tx


def plain(rows, width):
    starts = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        for i in range(len(t) - width + 1):
            starts[t[i : i + width]] = starts.get(t[i : i + width], 0) + 1
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    passages = [letters(int(n)) for n in rng.integers(10, 90, 6)] + ["ab" * 30, "x" * 70]
    out = []
    for d in range(120):
        parts = [letters(int(rng.integers(0, 60)))]
        for k in rng.integers(0, len(passages), int(rng.integers(0, 4))):
            a = int(rng.integers(0, 8))
            parts += [passages[k][a : a + int(rng.integers(5, 90))], letters(int(rng.integers(0, 25)))]
        out.append((d * 7 % 120, "".join(parts)))
    return [*out, out[11], (500, out[3][1]), (501, out[3][1]), (502, "abc" * 400), (503, "y" * 900)]


@pytest.mark.parametrize("width", [20, 40, 7, 1])
def test_against_all_windows(spark, rows, width):
    assert found(sa.remove_repeated_bytes(docs_of(spark, rows), width=width)) == plain(rows, width)


def test_hot_keys_many_ranges_and_pieces_of_long_texts(spark, rows, monkeypatch):
    """Keys of more than three segments go by fingerprints; several value ranges, shards and chunks."""
    monkeypatch.setattr(sa, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(sa, "VALUES_PER_RANGE", 40)
    monkeypatch.setattr(sa, "SHARD_BYTES", 2000)
    monkeypatch.setattr(sa.repeated_spans, "__defaults__", (20, 150))
    assert found(sa.remove_repeated_bytes(docs_of(spark, rows).repartition(5), width=20)) == plain(rows, 20)


def test_odd_rows(spark):
    assert found(sa.remove_repeated_bytes(docs_of(spark, ODD, "tag"), width=9)) == plain(ODD, 9)
    assert sa.remove_repeated_bytes(docs_of(spark, [])).collect() == []
    long = "0123456789 abc é " * 20
    got = sa.remove_repeated_bytes(docs_of(spark, [(1, long + "own"), (2, "x" + long)], "spans"), keep_bytes=True).collect()
    assert {r.doc_id: bytes(r.kept_bytes) for r in got} == {1: b"own", 2: b"x"}


def test_suffixes_in_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(40):
        data = rng.integers(0, 3, int(rng.integers(1, 900))).astype(np.uint8)
        data = np.tile(data[: max(1, len(data) // 7)], 9) if trial % 3 == 0 else data
        raw, depth = data.tobytes(), 32
        order, rank = sa.suffix_array(data, depth)
        ordered = [raw[i : i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order) == list(range(len(data))) and ordered == sorted(ordered)
        assert (np.diff(rank[order]) >= 0).all()
        shared = sa.common_prefixes(data, order, depth)
        for k in range(1, len(data)):
            a, b = raw[order[k - 1] :][:depth], raw[order[k] :][:depth]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_keys_near_themselves():
    rng = np.random.default_rng(1)
    for width in (4, 9, 30):
        data = rng.integers(0, 2, 400).astype(np.uint8)
        keys, more = sa.window_keys(data, width)
        short = width // 4
        hashes = tx.spans_hash(tx.CODES[data], np.arange(400 - short + 1), np.arange(400 - short + 1) + short)
        strings = width - short + 1
        assert keys.tolist() == [hashes[i : i + strings].min() for i in range(400 - width + 1)]
        twice = {int(k) for i, k in enumerate(keys) if (hashes[i : i + strings] == k).sum() > 1}
        assert twice <= set(more.tolist())


def test_intervals():
    assert sa.covered(np.array([7, 0, 3, 20]), np.array([3, 3, 4, 1])).tolist() == [[0, 10], [20, 21]]
    assert sa.covered(np.array([]), np.array([])).shape == (0, 2)


@pytest.mark.parametrize("width", [5, 8, 20, 200])
def test_wanted_suffixes_are_in_order(width):
    """Only windows are sorted to their end; the rounds leave out what none of them looks up."""
    rng = np.random.default_rng(width)
    parts = [rng.integers(97, 99, rng.integers(width, 3 * width), dtype=np.uint8) for _ in range(9)]
    texts = [p.tobytes() for p in (*parts, np.concatenate(parts[2:5]), np.zeros(2 * width, dtype=np.uint8), parts[0])]
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    at = [i for e, t in zip(ends, texts, strict=True) for i in range(e - len(t), e - width + 1)]
    wanted = np.zeros(len(data), dtype=bool)
    wanted[at] = True
    order, _ = sa.suffix_array(np.frombuffer(data, dtype=np.uint8), width, wanted)
    strings = [data[i : i + width] for i in order[wanted[order]].tolist()]
    assert sorted(order.tolist()) == list(range(len(data))) and strings == sorted(strings)
    every = [data[i : i + width] for i in at]
    got = [f for mask in sa.repeated_windows(texts, width) for f in mask.tolist()]
    assert got == [every.count(w) > 1 for w in every]


def test_a_shard_names_each_place_of_a_text_once(monkeypatch):
    """Equal texts of several chunks, touching texts, and a text that occurs once inside another one."""
    import pyarrow as pa

    calls, unique = [], np.unique
    monkeypatch.setattr(sa.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    place = lambda *p: np.array(p, dtype="<i8").tobytes()
    texts = [bytes([65 + i, 66 + i]) * 3 for i in range(40)]
    rows = [{"shard": 0, "key": i, "text": t, "places": place((i, i, 4)), "times": 1} for i, t in enumerate(texts) for _ in range(2)]
    rows += [{"shard": 0, "key": 99, "text": b"wxyzwx", "places": place((70, 7, 0)), "times": 1}, {"shard": 0, "key": 99, "text": b"xyzwxy", "places": place((71, 7, 9)), "times": 1}]
    rows += [{"shard": 0, "key": 98, "text": b"lonely", "places": place((72, 7, 0)), "times": 1}]
    got = sa._in_shard(5)(pa.Table.from_pylist(rows, sa._schema("shard long, key long, text binary, places binary, times long")))
    found = sorted(zip(*(got.column(c).to_pylist() for c in got.column_names), strict=True))
    assert found == [(i, i, 4, 10) for i in range(40)] + [(70, 7, 1, 6), (71, 7, 9, 14)]
    assert len(calls) <= 4  # not one a text


@pytest.mark.parametrize("width", [1, 4, 30])
def test_window_keys_by_blocks(monkeypatch, width):
    """Blocks give the keys of one pass, and each string that comes up near itself once, also across their edges."""
    rng = np.random.default_rng(width)
    data = np.concatenate([np.tile(rng.integers(0, 4, k, dtype=np.uint8), 900 // k) for k in (7, 20, 33, 300)])
    keys, more = sa.window_keys(data, width)
    for size in (1, 17, 64):
        monkeypatch.setattr(sa, "BLOCK_BYTES", size)
        part_keys, part_more = sa.window_keys(data, width)
        assert (part_keys == keys).all() and sorted(part_more) == sorted(more)
