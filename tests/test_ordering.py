import random

import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom.operators import windows as W
from stageloom.operators.ordering import dense_number, first_per_group, group_number, hot_groups, ordered_scan
from stageloom.scratch import materialise, shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; NULL is a key too."""
    rng = random.Random(1)
    data = [(("hot" if i % 3 else rng.choice(["a", "b", None])), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    return spark.createDataFrame(data, "k string, pos int, v int")


def test_scratch_uses_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = materialise(spark.range(5), "t")
    assert stored.count() == 5
    assert stored.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).split(":")[-1].lstrip("/"))


def test_dense_number_is_gapless_and_ordered(spark, skewed):
    out = dense_number(skewed, [("pos", "desc")], "rn", start=10, partitions=5)
    assert rows(out, "pos", "rn") == sorted(((299 - i, 11 + i) for i in range(300)), key=str)


def test_dense_number_of_nothing(spark, skewed):
    assert dense_number(skewed.where("pos < 0"), ["pos"]).count() == 0


def test_dense_number_needs_no_single_partition_window(spark, skewed, plan_of):
    plan = plan_of(dense_number(skewed, ["pos"], partitions=4))
    assert "SinglePartition" not in plan and "Window" not in plan


def test_hot_groups_are_found(skewed):
    assert hot_groups(skewed, ["k"], 1000) is None
    assert [r["k"] for r in hot_groups(skewed, ["k"], 100).collect()] == ["hot"]


SCANS = [
    {"rn": ("row_number", None), "n": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "prev": ("lag", "v")},
    lambda d: d.withColumn("flag", F.when(F.col("v").eqNullSafe(F.col("prev")), 0).otherwise(1)),
    {"run": ("sum", "flag")},
]


@pytest.mark.parametrize("limit", [7, 60, 100])
def test_split_groups_scan_like_whole_ones(skewed, limit):
    whole = ordered_scan(skewed, ["k"], ["pos"], SCANS, limit=10_000)
    split = ordered_scan(skewed, ["k"], ["pos"], SCANS, limit=limit)
    assert split.columns == whole.columns
    assert rows(split) == rows(whole)


def test_split_groups_in_descending_order(skewed):
    order = [("v", "desc"), "pos"]
    assert rows(group_number(skewed, ["k"], order, limit=9)) == rows(group_number(skewed, ["k"], order))


def test_first_per_group_is_limited_before_the_shuffle(skewed, plan_of):
    out = first_per_group(skewed, ["k"], ["pos"])
    plan = plan_of(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.count() == 4


@pytest.mark.parametrize("function", ["rank", "dense_rank", "sum", "avg", "max", "count", "percent_rank", "cume_dist"])
def test_window_columns_match_the_sql_default_frame(skewed, function):
    spec = W.WindowSpec("out", function, "pos", ["k"], ["v"])
    mine = W.window_columns(skewed, [spec], limit=20)
    skewed.createOrReplaceTempView("skewed")
    arg = "" if "rank" in function or function == "cume_dist" else "pos"
    sql = skewed.sparkSession.sql(
        f"SELECT *, {function}({arg}) OVER (PARTITION BY k ORDER BY v NULLS LAST) AS out FROM skewed"
    )
    assert rows(mine.withColumn("out", F.round("out", 6))) == rows(sql.withColumn("out", F.round("out", 6)))


@pytest.mark.parametrize("k", [1, 7, 250])
def test_ntile_and_lead_match_sql(skewed, k):
    specs = [W.WindowSpec("tile", "ntile", k, ["k"], ["pos"]), W.WindowSpec("nxt", "lead", "v", ["k"], [("v", "desc"), "pos"])]
    mine = W.window_columns(skewed, specs, limit=20)
    skewed.createOrReplaceTempView("skewed")
    sql = skewed.sparkSession.sql(
        f"""SELECT *, ntile({k}) OVER (PARTITION BY k ORDER BY pos) AS tile,
                   lead(v) OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, pos) AS nxt FROM skewed"""
    )
    assert rows(mine) == rows(sql)
    with pytest.raises(ValueError):
        W.window_columns(skewed, [W.WindowSpec("x", "mystery", "v", ["k"], ["pos"])])


def test_waves_and_chunks(skewed):
    sizes = W.waves(skewed, ["pos"], 50).groupBy("wave").count()
    assert rows(sizes) == [(i, 50) for i in range(1, 7)]
    chunks = W.chunk_groups(skewed, ["k"], ["pos"], size=33, min_size=3, limit=20)
    hot = chunks.where("k = 'hot'").groupBy("chunk").agg(F.count("*"), F.max("chunk_size"))
    assert rows(hot) == [(i, 33, 33) for i in range(6)]  # 200 rows: the last 2 are dropped


def test_collapse_runs(spark):
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate("aabbbacdefa")], "k string, p int, s string")
    for limit in (3, 100):
        assert rows(W.collapse_runs(df, ["k"], ["p"], "s", 5, limit)) == [
            ("x", 1, "a"), ("x", 2, "b"), ("x", 3, "a"), ("x", 4, "c"), ("x", 5, "d")
        ]


def test_budget_alerts_with_carried_totals(spark):
    df = spark.createDataFrame([("p", 1, 30.0), ("p", 2, 40.0), ("p", 3, 40.0), ("q", 1, 5.0)], "k string, t int, c double")
    old = spark.createDataFrame([("q", 95.5)], "k string, carried_total double")
    out = W.budget_alerts(df, ["k"], ["t"], "c", 100, carried=old)
    assert rows(out, "k", "t", "running_total", "alert") == [
        ("p", 1, 30.0, "ok"), ("p", 2, 70.0, "ok"), ("p", 3, 110.0, "over"), ("q", 1, 100.5, "over")
    ]


def test_keys_are_counted_only_in_heavy_slots(spark, monkeypatch, plan_of):
    """A table without hot groups is not shuffled by its keys; NULL keys count as a group."""
    from stageloom.operators import ordering

    plans, materialise = [], ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, label: plans.append(plan_of(df)) or materialise(df, label))
    df = spark.createDataFrame([(k, v) for v in range(4) for k in [None, *range(50)]], "k int, v int")
    assert ordering.hot_groups(df, ["k"], 4) is None and not plans
    more = df.unionByName(spark.createDataFrame([(None, 9), (7, 9)], "k int, v int"))
    assert sorted((r.k is None, r.k, r._n) for r in ordering.hot_groups(more, ["k"], 4).collect()) == [(False, 7, 5), (True, None, 5)]
    monkeypatch.setattr(ordering, "SLOTS", 1)
    assert ordering.hot_groups(df, ["k"], 4) is None and len(plans) == 2
