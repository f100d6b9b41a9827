from pathlib import Path

import pyarrow.parquet as pq
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom import scratch
from stageloom.operators import cdc as C
from stageloom.operators import usage as U
from stageloom.operators.joins import LookupSpec, lookup
from stageloom.sources import commits, deltas, files, sinks

DIM = "id long, name string, effective_start_date date, effective_end_date date, is_current boolean"


def test_scd2_with_repeated_and_null_keys(spark):
    dim = spark.sql("""SELECT 1L AS id, 'a' AS name, DATE'2024-01-01' AS effective_start_date, DATE'9999-12-31' AS effective_end_date, true AS is_current
        UNION ALL SELECT 1L, 'old', DATE'2023-01-01', DATE'2024-01-01', false UNION ALL SELECT 2L, 'odd', DATE'2023-01-01', DATE'2024-01-01', NULL
        UNION ALL SELECT NULL, 'nobody', DATE'2024-01-01', DATE'9999-12-31', true""")
    source = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (3, "n"), (None, "x"), (None, "y")], "id long, name string")
    got = C.scd2(dim, source, ["id"], ["name"], F.lit("2024-02-01"))
    out = sorted(((r.id, r.name, str(r.effective_start_date), r.is_current) for r in got.collect()), key=str)
    assert out == sorted([
        (1, "a", "2024-01-01", False), (1, "c", "2024-02-01", True), (1, "old", "2023-01-01", False),
        (2, "odd", "2023-01-01", None), (3, "n", "2024-02-01", True), (None, "nobody", "2024-01-01", True),
        (None, "x", "2024-02-01", True), (None, "y", "2024-02-01", True),
    ], key=str)


def test_merge_takes_one_source_row_per_key(spark):
    target = spark.createDataFrame([(1, "t", 0), (2, "u", 0), (None, "n", 0)], "id long, v string, at int")
    source = spark.createDataFrame([(1, "late", 9), (1, "early", 1), (None, "m", 5), (4, "new", 2)], "id long, v string, at int")
    got = C.merge_upsert(target, source, ["id"], order=["at"])
    assert rows(got) == sorted([(1, "late", 9), (2, "u", 0), (None, "n", 0), (None, "m", 5), (4, "new", 2)], key=str)


def test_null_keys_are_not_shuffled_into_one_join_task(spark):
    before = spark.createDataFrame([(None, 1), (1, 1)], "k long, v int")
    after = spark.createDataFrame([(None, 1), (1, 2)], "k long, v int")
    assert rows(C.change_capture(before, after, ["k"])) == sorted(
        [(1, 2, "update"), (None, 1, "insert"), (None, 1, "not_in_source")], key=str
    )


def test_a_pause_as_long_as_the_gap_stays_in_the_session(spark):
    df = spark.sql("""SELECT 'k' AS k, make_timestamp(2024, 1, 1, h, 0, 0) AS ts, false AS cached, 1 AS input_tokens, 1 AS output_tokens,
        CAST(1 AS DECIMAL(18,2)) AS cost, CAST(0 AS DECIMAL(18,2)) AS saved FROM VALUES (1), (2), (3), (5) AS t(h)""")
    got = U.session_summary(df, "k", "ts", ["ts"], 60)
    assert rows(got, "session_no", "requests") == [(1, 3), (2, 1)]
    window = df.groupBy(F.session_window("ts", "60 minutes"), "k").count()
    assert sorted(r["count"] for r in window.collect()) == [1, 3]


def test_cached_lookup_is_stored_once(spark):
    table = spark.createDataFrame([(1, "x", 0)], "id int, name string, unused int")
    spec = LookupSpec("t", table, "k", "id", ["name"], cache=True)
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(lookup(df, spec)) == rows(lookup(df, spec)) == [(1, "x"), (2, None)]
    assert len(spec._kept) == 1 and spec.stored().columns == ["id", "name"]


def test_grouped_read_leaves_the_session_alone(spark, tmp_path):
    spark.range(1000).repartition(12).write.parquet(str(tmp_path / "a" / "b"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = files.read_grouped(spark, str(tmp_path / "a"), group_bytes=1 << 30)
    assert df.count() == 1000 and df.rdd.getNumPartitions() == 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_scratch_lies_in_the_shared_folder_and_can_be_cleared(spark):
    import os

    path = scratch.new_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.materialise(spark.range(3), "kept")
    parent = os.path.dirname(path).removeprefix("file:")
    assert os.listdir(parent)


def row_files(base):
    """Rows of every parquet file below a table's data folder, by path."""
    return {str(p): pq.ParquetFile(p).metadata.num_rows for p in Path(base, "data").rglob("*.parquet")}


def table(spark, n, tag="a", first=0):
    return spark.range(first, first + n).select(F.col("id").alias("k"), F.concat(F.lit(tag), F.col("id")).alias("v"))


def test_an_upsert_writes_its_own_rows_and_not_the_table(spark, tmp_path):
    base = str(tmp_path / "t")
    deltas.upsert(table(spark, 20_000), base, ["k"])
    deltas.compact(spark, base, rows_per_bucket=500)
    before = row_files(base)
    assert sum(before.values()) >= 20_000
    spread = spark.range(1000).select((F.col("id") * 20).alias("k"), F.lit("new").alias("v"))
    deltas.upsert(spread, base, ["k"])
    added = {f: n for f, n in row_files(base).items() if f not in before}
    assert sum(added.values()) == 1000
    got = deltas.read(spark, base)
    assert got.count() == 20_000 and got.where("v = 'new'").count() == 1000 and got.where("v = 'new' AND k % 20 > 0").isEmpty()


def test_large_buckets_split_and_small_folds_leave_the_others_alone(spark, tmp_path):
    base = str(tmp_path / "t")
    deltas.upsert(table(spark, 1000), base, ["k"])
    assert deltas.compact(spark, base, rows_per_bucket=100) == 1
    state = commits.latest(spark, base)[1]
    assert len(state["buckets"]) == 16 and max(b["rows"] for b in state["buckets"]) < 150 and not state["deltas"]
    whole = rows(deltas.read(spark, base))
    assert whole == rows(table(spark, 1000))
    deltas.upsert(table(spark, 3, "b"), base, ["k"])
    assert deltas.compact(spark, base, rows_per_bucket=100) == 0  # three rows are not worth a rewrite
    deltas.upsert(table(spark, 2000, "c", 1000), base, ["k"])
    assert deltas.compact(spark, base, rows_per_bucket=100) == 16
    state = commits.latest(spark, base)[1]
    assert len(state["buckets"]) > 16 and sum(b["rows"] for b in state["buckets"]) == 3000 and not state["deltas"]
    want = sorted([*((k, f"b{k}") for k in range(3)), *((k, f"a{k}") for k in range(3, 1000)), *((k, f"c{k}") for k in range(1000, 3000))], key=str)
    assert rows(deltas.read(spark, base)) == want


def test_many_small_deltas_are_gathered_and_folded(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    monkeypatch.setattr(deltas, "SOME_DELTAS", 3)
    monkeypatch.setattr(deltas, "MOST_DELTAS", 4)
    deltas.upsert(table(spark, 400), base, ["k"])
    deltas.compact(spark, base, rows_per_bucket=100)
    want = {k: f"a{k}" for k in range(400)}
    for n in range(7):
        part = table(spark, 2, f"n{n}-", n)
        deltas.upsert(part, base, ["k"])
        want |= dict(rows(part))
        deltas.tidy(spark, base)
        assert dict(rows(deltas.read(spark, base))) == want
        assert len(commits.latest(spark, base)[1]["deltas"]) <= 4
    assert any(d.get("gathered") for d in commits.latest(spark, base)[1]["deltas"])
    deltas.upsert(table(spark, 300, "z"), base, ["k"])
    assert deltas.gather(spark, base) and not deltas.gather(spark, base)
    assert deltas.compact(spark, base, share=0) > 0 and not commits.latest(spark, base)[1]["deltas"]
    assert dict(rows(deltas.read(spark, base))) == want | {k: f"z{k}" for k in range(300)}


def test_two_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """A second upsert, and a third, commit between what the first reads and what it publishes."""
    base = str(tmp_path / "t")
    deltas.upsert(table(spark, 10), base, ["k"])
    others, publish = [table(spark, 1, "second", 3), table(spark, 1, "third", 4)], commits.publish

    def slow(*args):
        if others:
            deltas.upsert(others.pop(), base, ["k"])
        return publish(*args)

    monkeypatch.setattr(commits, "publish", slow)
    deltas.upsert(table(spark, 1, "first", 5), base, ["k"])
    got = dict(rows(deltas.read(spark, base)))
    assert [got[k] for k in (2, 3, 4, 5)] == ["a2", "second3", "third4", "first5"] and len(got) == 10
    assert commits.versions(spark, base)[-1] == 3


def test_an_upsert_during_a_compaction_stays_and_a_second_compaction_gives_up(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    deltas.upsert(table(spark, 50), base, ["k"])
    publish, turns = commits.publish, ["upsert", "compact"]

    def between(*args):
        if turns:
            turn = turns.pop(0)
            deltas.upsert(table(spark, 1, "late"), base, ["k"]) if turn == "upsert" else None
            if turn == "compact":
                raise AssertionError("published twice")
        return publish(*args)

    def conflicting(*args):
        monkeypatch.setattr(commits, "publish", publish)
        deltas.compact(spark, base)
        return publish(*args)

    turns.pop()
    monkeypatch.setattr(commits, "publish", between)
    assert deltas.compact(spark, base) == 1
    assert dict(rows(deltas.read(spark, base)))[0] == "late0"
    deltas.upsert(table(spark, 40, "z"), base, ["k"])
    monkeypatch.setattr(commits, "publish", conflicting)
    with pytest.raises(commits.ConcurrentCommit):
        deltas.compact(spark, base)
    got = dict(rows(deltas.read(spark, base)))
    assert got[39] == "z39" and got[40] == "a40" and len(got) == 50


def test_two_overwrites_of_one_version_raise(spark, tmp_path, monkeypatch):
    base, publish = str(tmp_path / "t"), commits.publish
    sinks.overwrite(spark.range(3), base)

    def late(*args):
        monkeypatch.setattr(commits, "publish", publish)
        sinks.overwrite(spark.range(5), base)
        return publish(*args)

    monkeypatch.setattr(commits, "publish", late)
    with pytest.raises(commits.ConcurrentCommit):
        sinks.overwrite(spark.range(7), base)
    assert sinks.read_current(spark, base).count() == 5
    assert sinks.overwrite(spark.range(9), base, version=1) == 1  # a repeated batch is left as it is
    assert sinks.read_current(spark, base).count() == 5
    for n in range(4):
        sinks.overwrite(spark.range(n), base)
    assert len([p for p in Path(base).iterdir() if p.name.startswith("v=")]) == commits.KEPT


def test_upserts_with_odd_keys_new_columns_removals_and_order(spark, tmp_path):
    base = str(tmp_path / "t")
    df = lambda data, extra="": spark.createDataFrame(data, f"a long, b string, v int{extra}")
    assert deltas.read(spark, base) is None and deltas.compact(spark, base) == 0
    deltas.upsert(df([(1, "x", 1), (1, "x", 2), (None, "x", 3), (None, "x", 3), (2, None, 4), (3, "y", 5)]), base, ["a", "b"])
    assert rows(deltas.read(spark, base)) == sorted([(1, "x", 2), (None, "x", 3), (None, "x", 3), (2, None, 4), (3, "y", 5)], key=str)
    deltas.compact(spark, base, rows_per_bucket=2)
    deltas.upsert(df([(3, "y", 0, "n", True), (1, "x", 9, "new", False), (None, "x", 3, None, None)], ", w string, gone boolean"), base, ["a", "b"], deleted="gone")
    want = sorted([(1, "x", 9, "new"), (None, "x", 3, None), (None, "x", 3, None), (None, "x", 3, None), (2, None, 4, None)], key=str)
    assert rows(deltas.read(spark, base), "a", "b", "v", "w") == want
    deltas.compact(spark, base, share=0)
    assert rows(deltas.read(spark, base), "a", "b", "v", "w") == want
    ordered = str(tmp_path / "o")
    for batch, data in enumerate([[(1, "x", 5), (2, "x", 1)], [(1, "x", 3), (2, "x", 7)], [(1, "x", 4)]]):
        assert deltas.upsert(df(data), ordered, ["a", "b"], ["v"], batch=("s", batch))
        assert not deltas.upsert(df([(1, "x", 99)]), ordered, ["a", "b"], ["v"], batch=("s", batch))
        deltas.compact(spark, ordered)
        deltas.upsert(df([]), ordered, ["a", "b"], ["v"])
    assert rows(deltas.read(spark, ordered)) == [(1, "x", 5), (2, "x", 7)]


def test_late_rows_at_the_bookmark_and_rows_without_a_key_are_read_once(spark):
    df = lambda data: spark.createDataFrame(data, "id long, at int")
    source, seen, last, got = [], None, None, []
    for arrivals in ([(1, 4), (2, 5), (3, None)], [(4, 5), (5, None)], [], [(6, 6), (7, 5), (8, 6)], [(9, 6), (3, 7)]):
        source += arrivals
        fresh, last = files.incremental_read(df(source), "at", last, seen)
        got.append(rows(fresh))
        seen = scratch.materialise(files.bookmark_rows(fresh, "at", last, seen), "seen")
    # (7, 5) came when the bookmark had moved on to 6 in the same read; rows below the bookmark count as read.
    assert got == [[(1, 4), (2, 5), (3, None)], [(4, 5), (5, None)], [], [(6, 6), (7, 5), (8, 6)], [(3, 7), (9, 6)]]
    assert last == 7 and rows(seen) == [(3, 7), (3, None), (5, None)]


def test_a_run_reads_late_rows(spark, tmp_path):
    base = str(tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "k long, seq long, v string")
    first = [(1, 5, "a"), (2, 5, "a"), (3, None, "a")]
    assert C.cdc_run(df(first), base, ["k"], "seq", ["seq"]) and not C.cdc_run(df(first), base, ["k"], "seq", ["seq"])
    assert C.cdc_run(df([*first, (4, 5, "late"), (5, None, "none")]), base, ["k"], "seq", ["seq"])
    assert not C.cdc_run(df([*first, (4, 5, "late"), (5, None, "none")]), base, ["k"], "seq", ["seq"])
    assert rows(sinks.read_current(spark, f"{base}/target"), "k") == [(k,) for k in range(1, 6)]


def test_changes_are_joined_with_one_scan_a_side(spark, tmp_path, plan_of):
    spark.range(50).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "a"))
    spark.range(20, 70).selectExpr("id", "id * 3 AS v").write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    for df in (C.merge_upsert(a, b, ["id"]), C.change_capture(a, b, ["id"])):
        assert plan_of(df).count("FileScan") == 2
