import datetime as dt

from table_rows import rows
from pyspark.sql import functions as F

from stageloom.operators import rules as R
from stageloom.operators import usage as U


def fleet(spark, jobs, links=()):
    stages = spark.createDataFrame([(j, t) for j, ts in jobs.items() for t in ts], "job_id string, type string")
    edges = spark.createDataFrame(list(links) or [("none", "a", "b")], "job_id string, from_stage string, to_stage string")
    return R.predictions(R.features(stages, edges, "job_id"))


def test_scores_and_categories(spark):
    jobs = {
        "copy": ["SequentialFile", "SequentialFile"],
        "readonly": ["FileSet"],
        "db": ["OracleConnector", "Transformer"],
        "cdc": ["Dataset", "ChangeCapture"] + ["Transformer"] * 3,
        "odd": ["Mystery", None, ""],
        "meta": ["CAnnotation", "CTrxInput"],
    }
    links = [("copy", "a", "b"), ("db", "a", "b"), ("db", "a", "c"), ("db", "a", "d")]
    out = {r.job_id: r for r in fleet(spark, jobs, links).collect()}
    assert out["copy"].score == 4 + 2 + 1.5
    assert out["copy"].migration_category == "AUTO - S3 to S3 ETL" and out["copy"].category == "AUTO"
    assert out["readonly"].migration_category == "AUTO - Read-Only (Athena candidate)"
    assert out["db"].score == 4 + 4 + 4.5 + 3 and out["db"].migration_category == "AUTO - Simple JDBC ETL"
    assert out["db"].risk_points == 15
    assert out["cdc"].migration_category == "MANUAL - CDC/SCD Pattern (Delta Lake)"
    assert out["cdc"].category == "MANUAL" and out["cdc"].risk_level == "CRITICAL"
    assert out["odd"].n_unknown == 1 and out["odd"].score == 6 + 6
    assert out["meta"].score == 4 and out["meta"].automation_ratio == 0
    # (2 + 2 * 0.5) * 1.075 * 0.5
    assert out["copy"].estimated_hours == 1.6
    assert abs(out["copy"].success_probability - 0.985) < 1e-12


def test_weight_overrides_and_caps(spark):
    stages = spark.createDataFrame([("j", "Mystery")] * 60, "job_id string, type string")
    links = spark.createDataFrame([("j", f"s{i % 9}", f"t{i}") for i in range(40)], "job_id string, from_stage string, to_stage string")
    assert R.features(stages, links, "job_id").first().score == 100.0
    light = R.features(stages, links, "job_id", {"Mystery": 0}).first()
    assert light.score == 30 + 0 + 20 + 10


def test_labels(spark):
    out = R.with_labels(fleet(spark, {"j": ["OracleConnector", "ChangeCapture"] + ["Transformer"] * 4})).first()
    assert "CDC/SCD logic must be manually validated" in out.rule_blockers
    assert "Multiple Transformers (4) - review SQL/logic" in out.rule_blockers
    assert out.features_needed == sorted(out.features_needed) and "JDBC Drivers" in out.features_needed


def test_calibration_feeds_predictions(spark):
    results = spark.createDataFrame([(10.0, 20.0, True), (10.0, 20.0, False)], "predicted_hours double, actual_hours double, success boolean")
    assert rows(R.calibration(results)) == [(2.0, 0.5)]
    stages = spark.createDataFrame([("j", "SequentialFile")] * 2, "job_id string, type string")
    links = spark.createDataFrame([("j", "a", "b")], "job_id string, from_stage string, to_stage string")
    out = R.calibrated_predictions(R.features(stages, links, "job_id"), results).first()
    assert out.estimated_hours == 3.2 and abs(out.success_probability - 0.635) < 1e-12


def test_priority_and_report(spark):
    p = fleet(spark, {"a": ["SequentialFile"] * 2, "b": ["ChangeCapture", "Pivot"]})
    ranked = R.priority_rank(R.with_priority(p).select("job_id", "priority"), "job_id")
    assert [r.job_id for r in ranked.orderBy("rank").collect()] == ["a", "b"]
    report = R.batch_report(p).first()
    assert (report.n_total, report.n_auto, report.n_manual, report.auto_pct) == (2, 1, 1, 50.0)


def test_token_estimates(spark):
    df = spark.createDataFrame([("",), ("abc",), ("  a   b\n" * 3,)], "t string")
    got = [r[0] for r in df.select(U.token_estimate(F.col("t"), "claude")).collect()]
    assert got == [0, 1, int(len("a b a b a b") / 3.5) + 1]
    name = spark.createDataFrame([("GPT-4o",), ("meta-llama-3",), (None,)], "m string")
    assert [r[0] for r in name.select(U.model_family(F.col("m"))).collect()] == ["gpt", "llama", "default"]
    talk = spark.createDataFrame([(1, "abcd"), (1, "")], "c int, t string")
    assert rows(U.conversation_tokens(talk, "c", "t")) == [(1, 4 + 2 + 4 + 0 + 2)]


def test_prices_fall_back(spark):
    data = [("azure", "gpt-4o-mini"), ("azure", "nope"), ("who", "claude-3-opus-20240229"), ("who", "nope")]
    df = spark.createDataFrame([(*d, 1000, 1000, False) for d in data], "provider string, model string, input_tokens long, output_tokens long, cached boolean")
    costs = {(r.provider, r.model): float(r.cost) for r in U.usage_cost(df).collect()}
    assert costs == {("azure", "gpt-4o-mini"): 0.00075, ("azure", "nope"): 0.02, ("who", "claude-3-opus-20240229"): 0.09, ("who", "nope"): 0.018}
    by_text = {r.model: float(r.cost) for r in U.cost_by_text(df).collect()}
    # 'gpt-4o' comes first in the list, so the mini price is never reached.
    assert by_text["gpt-4o-mini"] == 0.02 and by_text["nope"] == 0.04
    total = U.usage_totals(U.usage_records(df.withColumn("cached", F.col("provider") == "who")), 1.0).first()
    assert (total.total_requests, total.cached_requests, total.hit_rate) == (4, 2, 50.0)
    assert total.total_cost == 0.0208 and total.estimated_saving == 0.0208


def test_sessions_and_ttl(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    data = [(1, i, t(m), 10, 5, 0.5, 0.0, i % 2 == 0) for i, m in enumerate([0, 10, 45, 46, 200])]
    df = spark.createDataFrame(data, "u int, e int, ts timestamp, input_tokens long, output_tokens long, cost double, saved double, cached boolean")
    for limit in (2, 100):
        s = U.session_summary(df, "u", "ts", ["ts", "e"], 30, limit)
        assert rows(s, "session_no", "requests", "duration_us") == [(1, 2, 600_000_000), (2, 2, 60_000_000), (3, 1, 0)]
    cache = spark.createDataFrame([(1, t(0)), (1, t(45))], "u int, made timestamp")
    for limit in (2, 100):
        hits = U.ttl_match(df, cache, ["u"], "ts", "made", F.expr("INTERVAL 20 MINUTE"), limit)
        # At minute 45 the entry of that instant does not count yet and the first one is too old.
        assert rows(hits, "e", "hit") == [(0, False), (1, True), (2, False), (3, True), (4, False)]


def test_plan_cost_of_clusters(spark):
    data = [(i, "SEMI_AUTO", "c") for i in range(10)] + [(20, "MANUAL", None), (21, "AUTO", "c"), (22, "MANUAL", "d")]
    df = spark.createDataFrame(data, "id int, category string, cluster string")
    out = U.plan_cost(df, "id", "category", "cluster", "anthropic", 0.2).first()
    semi, manual = 0.006 + 0.0225, 0.009 + 0.0375
    assert (out.n_entities, out.calls, out.tokens) == (12, 2 + 2, 3500 + 525 + 2 * 5500)
    assert abs(out.cost_alone - (10 * semi + 2 * manual)) < 1e-9
    assert abs(out.cost_batched - (semi + 525 * 0.015 / 1000 + 2 * manual)) < 1e-9
    assert not out.over_budget
