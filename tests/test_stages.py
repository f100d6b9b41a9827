import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom.functions import text as X
from stageloom.functions.types import spark_type
from stageloom.operators import aggregate as A
from stageloom.operators import cdc as C
from stageloom.operators import joins as J
from stageloom.operators import project as P
from stageloom.operators import quality as Q
from stageloom.operators import sets as S
from stageloom.operators.sizing import broadcast_if_small
from stageloom.sources import sinks as K


def test_switch_takes_the_first_match(spark):
    df = spark.range(4)
    out = P.switch_route(df, [("small", F.col("id") < 2), ("odd", F.col("id") % 2 == 1)], "rest")
    assert rows(out) == [(0, "small"), (1, "small"), (2, "rest"), (3, "odd")]
    assert rows(P.switch_route(df.limit(1), [], "rest"), "route") == [("rest",)]


def test_filters_are_anded_and_pushed(spark, tmp_path, plan_of):
    spark.range(100).selectExpr("id", "id * 2 AS b", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = P.filter_all(spark.read.parquet(str(tmp_path / "t")), [F.col("id") > 5, F.col("b") < 16]).select("id")
    assert rows(df) == [(6,), (7,)]
    plan = plan_of(df)
    assert "GreaterThan(id,5)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_record_hash_reads_null_as_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "a")], "id int, x string, y string")
    h = {r["id"]: r["_record_hash"] for r in P.record_hash(df, ["id"]).collect()}
    assert h[1] == h[2] != h[3]


def test_cast_declared(spark):
    df = spark.createDataFrame([("7", "abcdef", "x")], "a string, b string, c string")
    out = P.cast_declared(
        df,
        [{"name": "a", "type": "Integer"}, {"name": "b", "type": "VarChar", "length": 3}, {"name": "c", "type": "Decimal", "precision": 8, "scale": 2}],
    )
    assert rows(out) == [(7, "abc", None)]
    assert dict(out.dtypes)["c"] == "decimal(8,2)"
    assert spark_type({"type": "ByteInt"}) == "tinyint"
    with pytest.raises(ValueError):
        spark_type({"type": "Mystery"})


def test_surrogate_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "n string")
    old = spark.createDataFrame([(41,), (7,)], "sk int")
    assert rows(P.surrogate_key(df, "sk", ["n"])) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(P.surrogate_key(df, "sk", ["n"], "continue", old, "sk")) == [("a", 42), ("b", 43), ("c", 44)]
    assert P.surrogate_key(df, "sk", mode="unique").select("sk").distinct().count() == 3


def test_lookup_defaults(spark, plan_of):
    main = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "none")], "id int, k string")
    ref = spark.createDataFrame([("k1", "v1"), ("k2", None)], "rk string, v string")
    spec = J.LookupSpec("ref", ref, "k", "rk", ["v"], defaults={"v": "dflt"})
    assert rows(J.lookup(main, spec), "id", "ref_v") == [(1, "v1"), (2, "dflt"), (3, "dflt")]
    assert rows(J.lookup(main, spec, miss_only=True), "id", "ref_v") == [(1, "v1"), (2, None), (3, "dflt")]
    assert "BroadcastHashJoin" in plan_of(J.lookup(main, spec))


def test_broadcast_only_below_the_checked_size(spark, plan_of):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = spark.range(1000).withColumn("x", F.rand(1)), spark.range(100)
        assert "BroadcastHashJoin" in plan_of(a.join(broadcast_if_small(b), "id"))
        assert "BroadcastHashJoin" not in plan_of(a.join(broadcast_if_small(b, max_rows=99), "id"))
        assert "BroadcastHashJoin" not in plan_of(a.join(broadcast_if_small(b, max_bytes=50), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_group_links_are_linear(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)] + [("h", 1)], "g string, m int")
    links = J.group_links(df, ["g"], "m")
    assert links.count() == 49 and links.select("left_id").distinct().count() == 1
    done = links.where("right_id < 10").select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    assert J.uncompared_pairs(links, done).count() == 40


def test_merge_stage_prefers_updates(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "A", 9), (2, None, 8)], "k int, v string, extra int")
    assert rows(J.merge_stage(master, updates, ["k"])) == [(1, "A", 9), (2, "b", 8)]


@pytest.fixture
def change_set(spark):
    before = spark.createDataFrame([(1, "same"), (2, "old"), (3, "gone"), (4, None)], "k int, v string")
    after = spark.createDataFrame([(1, "same"), (2, "new"), (4, ""), (5, "added")], "k int, v string")
    return before, after


def test_change_capture_tells_null_from_empty(change_set):
    assert rows(C.change_capture(*change_set, ["k"])) == [
        (1, "same", "unchanged"), (2, "new", "update"), (3, "gone", "not_in_source"), (4, "", "update"), (5, "added", "insert")
    ]


def test_change_apply(change_set):
    before, after = change_set
    assert rows(C.change_apply(before, after, ["k"])) == [(1, "same"), (2, "new"), (3, "gone"), (4, ""), (5, "added")]
    assert rows(C.change_apply(None, after, ["k"])) == rows(after)
    assert rows(J.changed_rows(P.record_hash(after, ["k"]), P.record_hash(before, ["k"]), ["k"], "_record_hash"), "k") == [(2,)]


def test_merge_upsert_defaults(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert rows(C.merge_upsert(target, source)) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None)]
    both = spark.createDataFrame([(2, "B", "Y")], "id int, v string, w string")
    assert rows(C.merge_upsert(target, both, ["id"], ["w"])) == [(1, "a", "x"), (2, "b", "Y")]


def test_latest_per_key_for_repeated_source_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "k int, seq int, v string")
    assert rows(C.latest_per_key(df, ["k"], ["seq"]), "v") == [("c",)]


def test_cdc_run_goes_on_after_the_bookmark(spark, tmp_path):
    base = str(tmp_path / "cdc")
    day = [(1, 1, "a"), (2, 2, "b"), (1, 3, "c")]
    df = lambda data: spark.createDataFrame(data, "k int, seq int, v string")
    run = lambda data: C.cdc_run(df(data), base, ["k"], "seq", ["seq"])
    assert run(day) and not run(day)
    assert rows(K.read_current(spark, f"{base}/target")) == [(1, 3, "c"), (2, 2, "b")]
    # A late row below the bookmark is not seen again.
    assert run([*day, (2, 4, "d"), (3, 0, "late")])
    assert rows(K.read_current(spark, f"{base}/target")) == [(1, 3, "c"), (2, 4, "d")]


def test_scd2_closes_opens_and_keeps(spark, change_set):
    before, after = change_set
    dim = C.scd2_initial(before, F.lit("2024-01-01"))
    once = C.scd2(dim, after, ["k"], ["v"], F.lit("2024-02-01"))
    versions = [(r.k, r.v, str(r.effective_start_date), str(r.effective_end_date), r.is_current) for r in once.collect()]
    assert (2, "old", "2024-01-01", "2024-02-01", False) in versions
    assert (2, "new", "2024-02-01", "9999-12-31", True) in versions
    assert (3, "gone", "2024-01-01", "9999-12-31", True) in versions
    assert (5, "added", "2024-02-01", "9999-12-31", True) in versions
    assert len(versions) == 7
    # Nothing changes on a repeat with the same source.
    assert rows(C.scd2(once, after, ["k"], ["v"], F.lit("2024-03-01"))) == rows(once)


def test_funnel_and_set_stages(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert rows(S.funnel(a, b)) == [(1, "x", None), (2, None, "y")]
    left, right = spark.range(3), spark.range(1, 5)
    assert rows(S.set_diff(left, right)) == [(0, "removed"), (1, "common"), (2, "common"), (3, "added"), (4, "added")]
    assert [r.id for r in S.tail_stage(spark.range(10), 3, ["id"]).collect()] == [9, 8, 7]
    assert [r.id for r in S.tail_stage(spark.range(10), 2, [("id", "desc")]).collect()] == [0, 1]


def test_bucket_edges_and_shares(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (59.0,), (60.0,)], "s double")
    assert rows(A.bucket_counts(df, "s", [30, 60])) == [("30-60", 2), ("<30", 1), (">=60", 1)]
    assert rows(A.percent_of_total(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), ["k"])) == [("a", 2, 66.7), ("b", 1, 33.3)]


def test_group_members_long_form(spark):
    df = spark.createDataFrame([("g", 3), ("g", 1), ("h", 2)], "g string, m int")
    assert rows(A.group_members(df, ["g"], "m")) == [("g", 1, 1, 2), ("g", 3, 2, 2), ("h", 2, 1, 1)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "test1", 100), (2, "test2", 200), (3, "test3", 300)], "id int, name string, value int")
    assert rows(Q.check_not_empty(df), "status", "n_rows") == [("PASS", 3)]
    assert rows(Q.check_not_empty(df.where("id > 9")), "status") == [("FAIL",)]
    assert rows(Q.check_null_keys(df, ["id", "name"])) == [("id", 0, "PASS"), ("name", 0, "PASS")]
    assert Q.missing_columns(df, {"id": "int", "name": "int", "x": "int"}) == ["name int", "x int"]
    assert rows(Q.check_row_preserving(df, df.select("id", "name")), "status") == [("PASS",)]
    same = Q.check_reconcile(df, df.orderBy("value"))
    assert rows(same) == [(3, 3, 0, 0, "PASS")]
    assert rows(Q.check_reconcile(df.union(df.limit(1)), df)) == [(4, 3, 1, 0, "FAIL")]


def test_load_declared_splits_rejects(spark):
    raw = spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c"), ("2", None)], "id string, v string")
    cols = [{"name": "id", "type": "Integer", "nullable": False}, {"name": "v", "type": "VarChar", "length": 5, "default": "none"}]
    good, rejects = K.load_declared(raw, cols, ["id"])
    assert rows(good) == [(1, "a"), (2, "none")]
    assert rows(rejects) == [(1, "b", "duplicate key"), (None, "c", "null id")]


def test_flatten_and_json_export(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    assert rows(K.flatten_arrays(df)) == [(1, "a; b")]
    assert rows(K.export_json(df)) == [('{"id":1,"tags":["a","b"]}',)]
    assert rows(K.stage_raw(df.select("id"))) == [('{"id":1}',)]


TEXTS = ["  a\t b \n\n\n\n c  \n", "", "x", "tr:  {  1 ,  2 }", " wide　 spaces "]


def test_text_functions_match_python(spark):
    import re

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    out = {r[0]: r for r in df.select("t", X.normalise_space(F.col("t")), X.clean_text(F.col("t")), X.compact_json(F.col("t"))).collect()}
    for t in TEXTS:
        clean = re.sub(r" +", " ", re.sub(r"\n\s*\n\s*\n+", "\n\n", t))
        clean = "\n".join(line.rstrip() for line in clean.split("\n")).strip()
        js = t
        for a, b in [(r":\s+", ": "), (r",\s+", ", "), (r"\{\s+", "{"), (r"\s+\}", "}"), (r"\[\s+", "["), (r"\s+\]", "]")]:
            js = re.sub(a, b, js)
        assert tuple(out[t])[1:] == (" ".join(t.split()), clean, js)


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a| b |c",)], "t string")
    one = lambda c: df.select(c).first()[0]
    assert one(X.field_trim(F.col("t"), "|", 2)) == "b"
    assert one(X.field_trim(F.col("t"), "|", 9)) == ""
    assert one(X.fmt_money(F.lit(1234.5))) == "$1,234.50"
    assert one(X.truncate_middle(F.lit("x" * 100), 12)) == "xxxxxx\n\n[... 90 chars truncated ...]\n\nxxxx"
    assert one(X.extract_score(F.lit("Similarity: 87 %"))) == 87.0
    assert one(X.extract_score(F.lit("none"))) == 50.0
    assert one(X.extract_lines(F.lit("Key a\nb\nkey c\nkey d\nkey e"), "key", 3)) == "key a key c key d"
    assert one(X.extract_lines(F.lit("Key a\nb\nkey c\nkey d\nkey e"), "key")) == "key a key c key d key e"
    assert one(X.extract_lines(F.lit("nothing"), "key")) == "N/A"
    assert one(X.extract_block(F.lit("x ```python\nimport a\n``` y"))) == "import a"
    assert one(X.extract_block(F.lit("x ```py\nb = 1\n``` y"))) == "b = 1"
    assert one(X.extract_block(F.lit("import a\ndef f(): pass "))) == "import a\ndef f(): pass"
    assert one(X.extract_block(F.lit("plain"))) is None
    assert one(X.replace_terms(F.lit("PxSequentialFile to OracleConnectorPX"))) == "SeqFile to OraclePX"
    assert one(X.keyword_tags(F.lit("Merge ORDER lines"))) == ["merge", "order"]
    assert one(X.safe_name(F.lit("A b//C?"))) == "a_b_c"
    assert one(X.safe_name(F.lit("1 a-b.c"), "variable")) == "stage_1_a_b_c"
    assert one(X.safe_name(F.lit("1 A-b"), "job")) == "job_1_a_b"
    assert one(X.json_long(F.lit("not json"), "$.k", 3)) == 3


def test_label_counts_clean_distinct_values_after_counting(spark):
    texts = spark.createDataFrame([("a1 b a2",), ("a b! 7",), (None,), ("",)], "text string")
    letters = lambda x: F.regexp_replace(x, "[^a-z]+", "")
    counts = A.label_counts(texts.select(F.split("text", " ").alias("words")), "words", clean=letters)
    assert rows(counts) == [("", 2), ("a", 3), ("b", 2)]
