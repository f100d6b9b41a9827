import datetime as dt

import pytest
from table_rows import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stageloom.operators.cdc import change_apply
from stageloom.sources.jdbc import read_kafka
from stageloom.sources.sinks import overwrite, read_current, read_version
from stageloom.streaming import jobs as J
from stageloom.streaming import stateful
from stageloom.streaming.stateful import rocksdb_state

SCHEMA = "k string, seq int, ts timestamp, v double"


def arrive(spark, path, batch):
    t = dt.datetime(2024, 1, 1)
    data = [(k, s, t + dt.timedelta(minutes=s), float(v)) for k, s, v in batch]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


BATCHES = [[("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], [("b", 4, 4), ("c", 5, 5)], [("a", 6, 6)]]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i, batch in enumerate(BATCHES):
        arrive(spark, src, batch)
        J.ingest(J.read_files(spark, src, SCHEMA), out, cp)
        assert spark.read.parquet(out).count() == sum(len(b) for b in BATCHES[: i + 1])


def test_upserts_batch_by_batch(spark, tmp_path):
    src, base, cp = (str(tmp_path / n) for n in ("src", "base", "cp"))
    for batch in BATCHES:
        arrive(spark, src, batch)
        J.apply_changes(J.read_files(spark, src, SCHEMA), base, ["k"], ["seq"], cp)
    assert rows(read_current(spark, base), "k", "seq") == [("a", 6), ("b", 4), ("c", 5)]


def test_a_repeated_batch_reads_the_version_before_it(spark, tmp_path):
    base = str(tmp_path / "base")
    change = spark.createDataFrame([("a", 1)], "k string, v int")
    overwrite(change, base, version=0)
    for _ in range(2):
        target = read_version(spark, base, 1)
        overwrite(change_apply(target, change.withColumn("v", F.col("v") + 1), ["k"]), base, version=1)
    assert rows(read_current(spark, base)) == [("a", 2)]


@pytest.mark.parametrize("files", [None, 1])
def test_windows_and_sessions_do_not_depend_on_batching(spark, tmp_path, files):
    src = str(tmp_path / "src")
    for batch in BATCHES:
        arrive(spark, src, batch)
    stream = lambda: J.read_files(spark, src, SCHEMA, files_per_batch=files)
    totals = J.usage_per_window(stream(), "ts", ["k"], {"n": F.count(F.lit(1)), "v": F.sum("v")}, "5 minutes", "1 day")
    J.write_changes(totals, str(tmp_path / "w"), ["window_start", "k"], str(tmp_path / "cpw"))
    assert rows(read_current(spark, str(tmp_path / "w")), "k", "n", "v") == [
        ("a", 1, 6.0), ("a", 2, 3.0), ("b", 2, 7.0), ("c", 1, 5.0)
    ]
    with rocksdb_state(spark):
        sessions = J.sessions(stream(), "ts", "k", "3 minutes", "1 day", "v")
        J.write_changes(sessions, str(tmp_path / "s"), ["k", "session_start"], str(tmp_path / "cps"), deleted="gone")
        assert rows(read_current(spark, str(tmp_path / "s")), "k", "requests") == [("a", 1), ("a", 2), ("b", 2), ("c", 1)]
        first = J.drop_repeats(stream(), "ts", ["k"], "1 day").select("k")
        J.ingest(first, str(tmp_path / "d"), str(tmp_path / "cpd"))
    assert rows(spark.read.parquet(str(tmp_path / "d"))) == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("files", [None, 1])
def test_running_budget_carries_totals(spark, tmp_path, files):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for batch in BATCHES:
        arrive(spark, src, batch)
    J.running_budget(J.read_files(spark, src, SCHEMA, files_per_batch=files), out, ["k"], ["seq"], "v", 9, cp, late="1 day")
    assert rows(spark.read.parquet(out), "k", "seq", "running_total", "alert") == [
        ("a", 1, 1.0, "ok"), ("a", 2, 3.0, "ok"), ("a", 6, 9.0, "over"), ("b", 3, 3.0, "ok"), ("b", 4, 7.0, "ok"), ("c", 5, 5.0, "ok")
    ]


def held(progress):
    """State rows after the last batch."""
    return progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_finished_windows_leave_the_state_and_stay_in_the_result(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for batch in ([("a", 1, 1), ("b", 2, 2)], [("a", 60, 3)], [("a", 200, 4)], [("a", 3, 5)]):  # the last is too late
        arrive(spark, src, batch)
        totals = J.usage_per_window(J.read_files(spark, src, SCHEMA), "ts", ["k"], {"n": F.count(F.lit(1))}, "5 minutes", "10 minutes")
        progress = J.write_changes(totals, out, ["window_start", "k"], cp)
    assert held(progress) == 1
    assert rows(read_current(spark, out), "k", "n") == [("a", 1), ("a", 1), ("a", 1), ("b", 1)]


def test_late_rows_join_sessions_and_finished_ones_leave_the_state(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    want = [[("a", 0, 1)], [("a", 0, 1), ("a", 20, 1)], [("a", 0, 3)], [("a", 0, 3), ("a", 500, 1)]]
    for batch, sessions in zip([[("a", 0, 1)], [("a", 20, 1)], [("a", 10, 1)], [("a", 500, 1)]], want, strict=True):
        arrive(spark, src, batch)
        with rocksdb_state(spark):
            changes = J.sessions(J.read_files(spark, src, SCHEMA), "ts", "k", "10 minutes", "1 hour", "v")
            J.write_changes(changes, out, ["k", "session_start"], cp, deleted="gone")
        minute = ((F.unix_seconds("session_start") - F.lit(1704067200)) / 60).cast("int").alias("m")
        assert rows(read_current(spark, out).select("k", minute, "requests")) == sorted(sessions, key=str)


def test_state_is_dropped_after_the_ttl(spark, tmp_path):
    """A silent key starts again: its total is zero and its request is a first one."""
    src = str(tmp_path / "src")
    found, spent = [], []
    for batch in ([("a", 0, 5), ("a", 1, 5), ("b", 1, 1)], [("c", 300, 1)], [("a", 301, 2), ("c", 302, 1)]):
        arrive(spark, src, batch)
        stream = J.read_files(spark, src, SCHEMA)
        with rocksdb_state(spark):
            J.ingest(J.drop_repeats(stream, "ts", ["k"], "10 minutes", "1 minute"), str(tmp_path / "d"), str(tmp_path / "cpd"))
        J.running_budget(stream, str(tmp_path / "r"), ["k"], ["seq"], "v", 99, str(tmp_path / "cpr"), late="1 minute", ttl="10 minutes")
        found.append(rows(spark.read.parquet(str(tmp_path / "d")), "k", "seq"))
        spent.append(rows(spark.read.parquet(str(tmp_path / "r")), "k", "seq", "running_total"))
    assert found[0] == [("a", 0), ("b", 1)] and found[-1] == [("a", 0), ("a", 301), ("b", 1), ("c", 300)]
    assert spent[-1] == [("a", 0, 5.0), ("a", 1, 10.0), ("a", 301, 2.0), ("b", 1, 1.0), ("c", 300, 1.0), ("c", 302, 2.0)]


def test_keys_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    """Many keys, also NULL ones and large numbers, in two buckets: results are those of each key, state is read and written by bucket."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    big, start = (1 << 60) + 1, dt.datetime(2024, 1, 1)
    src = str(tmp_path / "src")
    keys = [None, big, big + 1, *range(20)]
    for minutes in ([0, 1], [2, 30]):
        data = [(k, None if m == 1 else m, start + dt.timedelta(minutes=m), 1.0) for k in keys for m in minutes]
        spark.createDataFrame(data, "k long, seq long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: J.read_files(spark, src, "k long, seq long, ts timestamp, v double", files_per_batch=1)
    by = lambda found: sorted(found, key=lambda r: tuple((x is not None, x) for x in r))
    J.running_budget(stream(), str(tmp_path / "r"), ["k"], ["seq"], "v", 99, str(tmp_path / "cpr"), late="1 day")
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).select("k", "seq", "running_total").collect()]
    first = {0: 1.0, None: 2.0}  # NULLs come last
    assert by(got) == by([(k, s, t) for k in keys for s, t in (*first.items(), (2, 3.0), (30, 4.0))])
    with rocksdb_state(spark):
        changes = J.sessions(stream(), "ts", "k", "10 minutes", "1 day", "v")
        progress = J.write_changes(changes.where("k IS NOT NULL"), str(tmp_path / "s"), ["k", "session_start"], str(tmp_path / "cps"), deleted="gone")
        J.ingest(J.drop_repeats(stream(), "ts", ["k"], "1 day").select("k"), str(tmp_path / "d"), str(tmp_path / "cpd"))
    got = [tuple(r) for r in read_current(spark, str(tmp_path / "s")).select("k", "requests").collect()]
    assert by(got) == by([(k, n) for k in keys[1:] for n in (3, 1)])
    assert held(progress) == 2
    assert by([tuple(r) for r in spark.read.parquet(str(tmp_path / "d")).collect()]) == by([(k,) for k in keys])


def test_kafka_reader_needs_its_package(spark):
    with pytest.raises(AnalysisException):
        read_kafka(spark, "nowhere:1", "topic")
