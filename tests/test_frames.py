import random

import pyarrow as pa
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom.operators import ordering
from stageloom.operators import windows as W
from stageloom.operators.custom import GroupLogic, custom_groups
from stageloom.operators.joins import full_join, hot_keys, join_stage


@pytest.mark.parametrize("limit", [None, 4])
def test_interval_frames_of_any_width(spark, limit):
    """Also cut into blocks of four rows: frames inside one, over many, beside the row, empty and of NULL values."""
    rng = random.Random(3)
    data = [(g, None if rng.random() < 0.1 else rng.randrange(40), i, None if i % 9 == 0 else rng.randrange(100)) for i, g in enumerate("a" * 60 + "b" * 7 + "c")]
    df = spark.createDataFrame(data, "g string, x int, id int, v int")
    ends = [(-3, 0), (-10, 10), (2, 30), (-40, 40), (5, 5)]
    functions = ["sum", "count", "avg", "min", "max"]
    specs = [W.WindowSpec(f"{f}{k}", f, "v", ["g"], ["x"], interval=e) for k, e in enumerate(ends) for f in (functions if limit is None else [["sum"], [], ["min"], ["max"], []][k])]
    got = {r.id: r for r in W.window_columns(df, specs, limit).collect()}
    assert len(got) == len(data)
    for g, x, i, _ in data:
        for spec in specs:
            low, high = spec.interval
            near = [v for h, y, _, v in data if h == g and v is not None and (y is None if x is None else y is not None and x + low <= y <= x + high)]
            value = {"count": len(near), "sum": sum(near), "avg": sum(near) / max(1, len(near)), "min": min(near, default=None), "max": max(near, default=None)}[spec.function]
            want = value if near or spec.function == "count" else None
            assert got[i][spec.out] == (pytest.approx(want) if want is not None else None), (spec, i)


@pytest.mark.parametrize("hot", ["left", "both", "one side"])
def test_full_join_of_hot_keys(spark, hot):
    rng = random.Random(7)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), "x", i) for i in range(90)]
    right = [(rng.choice([1, 2, 4, None] if hot == "left" else [1, 1, 1, 4, None] if hot == "both" else [4, 4, 4, 5, None]), "x", -i) for i in range(50)]
    a, b = spark.createDataFrame(left, "k int, p string, v int"), spark.createDataFrame(right, "k int, p string, w int")
    for keys in [["k"]] if hot != "both" else [["k"], ["k", "p"]]:
        want = a.join(b, keys, "full")
        got = full_join(a, b, keys, limit=9)
        assert got.columns == want.columns and rows(got) == rows(want) == rows(join_stage(a, b, keys, how="outer"))
    named = b.toDF("k2", "p", "w")
    got = full_join(a, named, ["k"], ["k2"], limit=9)
    assert got.columns == ["k", "p", "v", "k2", "p", "w"]
    assert rows(got.toDF(*"abcdef")) == rows(a.join(named, a.k == named.k2, "full").toDF(*"abcdef"))


def test_a_key_with_half_the_rows_spreads_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 500)
    a = spark.range(20_000).select(F.when(F.col("id") < 10_000, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    b = spark.range(15_000).select(F.when(F.col("id") == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("other"))
    b = b.unionByName(spark.range(100).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("other")))
    assert rows(hot_keys(a, ["k"], 500)) == [(-1, 10_000)] and hot_keys(b, ["k"], 500) is None
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_stage(a, b, ["k"], how="full")
        hot = joined.where("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = sorted(r["count"] for r in hot)
        assert sum(sizes) == 10_000 and len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        assert joined.count() == a.join(b, ["k"], "full").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_larger_than_a_batch_come_in_slices_and_in_order(spark):
    class Gaps(GroupLogic):
        """Differences of neighbouring values, and how many slices the group came in."""

        def start(self, key):
            self.key, self.last, self.slices = key["g"], None, 0

        def rows(self, part):
            self.slices += 1
            out = []
            for v in part.column("v").to_pylist():
                out.append(None if self.last is None else v - self.last)
                self.last = v
            yield pa.RecordBatch.from_pydict({"g": [self.key] * len(out), "gap": pa.array(out, pa.int64()), "slices": pa.array([None] * len(out), pa.int64())})

        def end(self):
            yield pa.RecordBatch.from_pydict({"g": [self.key], "gap": pa.array([None], pa.int64()), "slices": [self.slices]})

    data = [(g, v * v) for g, n in (("a", 95), ("b", 3), (None, 4), ("", 1)) for v in range(n)]
    random.Random(1).shuffle(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = custom_groups(spark.createDataFrame(data, "g string, v long"), ["g"], ["v"], Gaps, "g string, gap long, slices long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    gaps = {g: sorted(r.gap for r in got if r.g == g and r.gap is not None) for g in ("a", "b", None, "")}
    assert gaps == {"a": [2 * v + 1 for v in range(94)], "b": [1, 3], None: [1, 3, 5], "": []}
    slices = {r.g: r.slices for r in got if r.slices is not None}
    assert slices["a"] >= 10 and set(slices) == {"a", "b", None, ""}
