"""Scores, classes, ranks and reports over the derived steps and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.operators import aggregate as A
from stageloom.operators import rules as R
from stageloom.operators.rule_tables import MANUAL, SOURCES, TARGETS, TRANSFORMS
from stageloom.plans import fleet as G
from stageloom.plans.registry import query
from stageloom.tables import load

P = G.PREDICTIONS_SQL


def features(spark, d):
    s = G.stages(spark, d)
    return R.features(s, G.links(spark, d, s), "job_id")


def predictions(spark, d):
    return R.predictions(features(spark, d))


@query("complexity_score", G.FEATURES_SQL + "SELECT job_id, n_stages, n_links, n_branches, score FROM scored")
def complexity_score(spark, d):
    return features(spark, d).select("job_id", "n_stages", "n_links", "n_branches", "score")


@query("migration_category", P + "SELECT job_id, migration_category FROM predictions")
def migration_category(spark, d):
    return R.migration_category(features(spark, d)).select("job_id", "migration_category")


@query(
    "automation_ratio",
    P + "SELECT job_id, n_full, n_partial, n_manual, n_unknown, round(automation_ratio, 6) AS automation_ratio FROM predictions",
)
def automation_ratio(spark, d):
    return R.with_automation(features(spark, d)).select(
        "job_id", "n_full", "n_partial", "n_manual", "n_unknown", F.round("automation_ratio", 6).alias("automation_ratio")
    )


@query("risk_score", P + "SELECT job_id, risk, factors FROM predictions")
def risk_score(spark, d):
    return R.with_risk(features(spark, d)).select(
        "job_id", "risk", F.array_join("risk_factors", "\n").alias("factors")
    )


@query("classify_confidence", P + "SELECT job_id, category, round(confidence, 6) AS confidence FROM predictions")
def classify_confidence(spark, d):
    return predictions(spark, d).select("job_id", "category", F.round("confidence", 6).alias("confidence"))


@query("success_probability", P + "SELECT job_id, round(success_probability, 6) AS success_probability FROM predictions")
def success_probability(spark, d):
    return predictions(spark, d).select("job_id", F.round("success_probability", 6).alias("success_probability"))


@query("effort_hours", P + "SELECT job_id, estimated_hours FROM predictions")
def effort_hours(spark, d):
    return predictions(spark, d).select("job_id", "estimated_hours")


@query("risk_level", P + "SELECT job_id, risk_level FROM predictions")
def risk_level(spark, d):
    return predictions(spark, d).select("job_id", "risk_level")


@query(
    "label_arrays",
    P + """SELECT job_id,
      concat_ws('|', CASE WHEN category = 'AUTO' THEN '✅ Good candidate for automated migration|Run generated script in Glue Dev Endpoint for validation' END,
        CASE WHEN category = 'SEMI_AUTO' THEN '📝 Review generated template and complete TODOs|Test with sample data before full migration' END,
        CASE WHEN category = 'MANUAL' THEN '⚠️ Requires manual analysis and custom implementation|Consider breaking into smaller, simpler jobs' END,
        CASE WHEN any_change THEN '💡 Use Glue Bookmarks for incremental processing|Consider Delta Lake or Apache Iceberg for CDC' END,
        CASE WHEN contains(factors, 'Lookup') THEN '💡 Use broadcast joins for small lookup tables|Consider caching lookup data in Glue Data Catalog' END,
        CASE WHEN any_teradata THEN '🔧 Configure Teradata JDBC driver in Glue|Consider migrating Teradata tables to Redshift first' END,
        CASE WHEN n_stages > 10 THEN '📊 Complex job - consider modularizing into multiple Glue jobs' END) AS recommendations,
      concat_ws('|', CASE WHEN score > 60 THEN 'CloudWatch Logs' END, CASE WHEN any_change THEN 'Delta Lake / Iceberg (recommended)' END,
        CASE WHEN any_connector THEN 'Glue Connection (JDBC)' END, CASE WHEN any_file THEN 'Glue Data Catalog' END,
        CASE WHEN score > 60 THEN 'Glue Dev Endpoint (testing)' END, 'Glue ETL Job',
        CASE WHEN any_teradata THEN 'Glue Marketplace Connector (optional)' END, 'IAM Role for Glue',
        CASE WHEN any_jdbc THEN 'JDBC Drivers' END, CASE WHEN any_change THEN 'Job Bookmarks' END,
        CASE WHEN any_file THEN 'S3 Bucket' END, CASE WHEN any_connector THEN 'Secrets Manager (credentials)' END,
        CASE WHEN score > 60 THEN 'Spark UI' END, CASE WHEN any_teradata THEN 'Teradata JDBC Driver (custom)' END,
        CASE WHEN any_connector THEN 'VPC Configuration' END) AS features_needed,
      concat_ws('|', CASE WHEN any_change THEN 'CDC/SCD logic must be manually validated' END,
        CASE WHEN contains(lower(factors), 'custom') THEN 'Custom code/routines need manual conversion' END,
        CASE WHEN n_transformers > 3 THEN 'Multiple Transformers (' || n_transformers || ') - review SQL/logic' END) AS rule_blockers
      FROM predictions""",
)
def label_arrays(spark, d):
    labelled = R.with_labels(predictions(spark, d))
    return labelled.select(
        "job_id",
        *[F.array_join(c, "|").alias(c) for c in ("recommendations", "features_needed", "rule_blockers")],
    )


_TYPE_BLOCKER = "SELECT DISTINCT job_id, 'Stage type ''' || type || ''' requires manual implementation' AS blocker FROM stages WHERE type IN " + G.sql_list(MANUAL)


@query("type_blockers", f"WITH {G.STAGES_SQL} {_TYPE_BLOCKER}")
def type_blockers(spark, d):
    return R.type_blockers(G.stages(spark, d), "job_id")


@query(
    "common_blockers",
    P + f""", blockers AS ({_TYPE_BLOCKER}
       UNION ALL SELECT job_id, 'CDC/SCD logic must be manually validated' FROM predictions WHERE any_change
       UNION ALL SELECT job_id, 'Custom code/routines need manual conversion' FROM predictions WHERE contains(lower(factors), 'custom')
       UNION ALL SELECT job_id, 'Multiple Transformers (' || n_transformers || ') - review SQL/logic' FROM predictions WHERE n_transformers > 3)
       SELECT blocker, count(*) AS n FROM blockers GROUP BY 1 ORDER BY n DESC, blocker LIMIT 10""",
)
def common_blockers(spark, d):
    s = G.stages(spark, d)
    rows = R.with_labels(R.predictions(R.features(s, G.links(spark, d, s), "job_id")))
    return R.common_blockers(s, rows, "job_id", 10)


REPORT_SQL = """SELECT count(*) AS n_total, count(*) FILTER (category = 'AUTO') AS n_auto, count(*) FILTER (category = 'SEMI_AUTO') AS n_semi,
  count(*) FILTER (category = 'MANUAL') AS n_manual, round(100.0::DOUBLE * count(*) FILTER (category = 'AUTO') / count(*), 1) AS auto_pct,
  round(100.0::DOUBLE * count(*) FILTER (category = 'SEMI_AUTO') / count(*), 1) AS semi_pct,
  round(100.0::DOUBLE * count(*) FILTER (category = 'MANUAL') / count(*), 1) AS manual_pct,
  CAST(round(sum(success_probability::DECIMAL(18,6)) / count(*) * 100, 1) AS DOUBLE) AS mean_success_pct,
  CAST(sum(estimated_hours::DECIMAL(18,1)) AS DOUBLE) AS total_hours,
  count(*) FILTER (risk_level = 'LOW') AS n_low, count(*) FILTER (risk_level = 'MEDIUM') AS n_medium,
  count(*) FILTER (risk_level = 'HIGH') AS n_high, count(*) FILTER (risk_level = 'CRITICAL') AS n_critical FROM predictions"""


@query("batch_report", P + REPORT_SQL)
def batch_report(spark, d):
    return R.batch_report(predictions(spark, d))


@query(
    "summary_row",
    P + """SELECT risk_level, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM predictions), 1) AS pct,
       CAST(sum(estimated_hours::DECIMAL(18,1)) AS DOUBLE) AS hours FROM predictions GROUP BY 1""",
)
def summary_row(spark, d):
    rows = predictions(spark, d)
    share = A.percent_of_total(rows, ["risk_level"])
    hours = rows.groupBy("risk_level").agg(
        F.sum(F.col("estimated_hours").cast("decimal(18,1)")).cast("double").alias("hours")
    )
    return share.join(hours, "risk_level")


RESULTS_SQL = """SELECT o_totalprice::DECIMAL(18,2) AS predicted_hours, (o_totalprice + o_custkey)::DECIMAL(18,2) AS actual_hours,
  o_orderstatus <> 'P' AS success FROM orders"""


def results(spark, d):
    """Predicted and actual values of finished work, taken from orders."""
    return load(spark, d, "orders").select(
        F.col("o_totalprice").cast("decimal(18,2)").alias("predicted_hours"),
        (F.col("o_totalprice") + F.col("o_custkey")).cast("decimal(18,2)").alias("actual_hours"),
        (F.col("o_orderstatus") != "P").alias("success"),
    )


@query(
    "calibration",
    f"""SELECT round(CAST(sum(actual_hours) AS DOUBLE) / CAST(sum(predicted_hours) AS DOUBLE), 6) AS effort_factor,
               round(avg(CAST(success AS INTEGER)), 6) AS success_baseline FROM ({RESULTS_SQL})""",
)
def calibration(spark, d):
    return R.calibration(results(spark, d)).select(
        F.round(F.col("effort_factor").cast("double"), 6).alias("effort_factor"),
        F.round("success_baseline", 6).alias("success_baseline"),
    )


CALIBRATED_SQL = P.replace("0.85::DOUBLE + automation_ratio", "(SELECT avg(CAST(success AS INTEGER)) FROM results) + automation_ratio").replace(
    "AS DECIMAL(18,6)), 1) AS DOUBLE) AS estimated_hours",
    "AS DECIMAL(18,6)) * CAST((SELECT CAST(sum(actual_hours) AS DOUBLE) / CAST(sum(predicted_hours) AS DOUBLE) FROM results) AS DECIMAL(10,4)), 1) AS DOUBLE) AS estimated_hours",
).replace("WITH stages", f"WITH results AS ({RESULTS_SQL}), stages", 1)


@query(
    "calibrated_predictions",
    CALIBRATED_SQL
    + "SELECT job_id, round(success_probability, 6) AS success_probability, estimated_hours FROM predictions",
)
def calibrated_predictions(spark, d):
    return R.calibrated_predictions(features(spark, d), results(spark, d)).select(
        "job_id", F.round("success_probability", 6).alias("success_probability"), "estimated_hours"
    )


PRIORITY_SQL = """, ranked AS (SELECT job_id, round(0.3::DOUBLE * (CASE category WHEN 'AUTO' THEN 1.0 WHEN 'SEMI_AUTO' THEN 0.5 ELSE 0.2 END)::DOUBLE
    + 0.25::DOUBLE * success_probability + 0.2::DOUBLE * 0.5::DOUBLE
    + 0.15::DOUBLE * (1.0::DOUBLE - estimated_hours / (SELECT max(estimated_hours) FROM predictions))
    + 0.1::DOUBLE * (CASE risk_level WHEN 'LOW' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 WHEN 'HIGH' THEN 0.4 ELSE 0.1 END)::DOUBLE, 3) AS priority
  FROM predictions)
"""


def _ranked_columns(spark, d):
    return predictions(spark, d).select("job_id", "category", "success_probability", "estimated_hours", "risk_level")


@query(
    "priority_rank",
    P + PRIORITY_SQL + "SELECT job_id, priority, row_number() OVER (ORDER BY priority DESC, job_id) AS rank FROM ranked",
)
def priority_rank(spark, d):
    return R.priority_rank(R.with_priority(_ranked_columns(spark, d)).select("job_id", "priority"), "job_id")


@query(
    "priority_waves",
    P + PRIORITY_SQL + "SELECT job_id, (row_number() OVER (ORDER BY priority DESC, job_id) - 1) // 50 + 1 AS wave FROM ranked",
)
def priority_waves(spark, d):
    from stageloom.operators.windows import waves

    ranked = R.with_priority(_ranked_columns(spark, d)).select("job_id", "priority")
    return waves(ranked, [("priority", "desc"), "job_id"]).select("job_id", "wave")


@query(
    "portfolio_report",
    P + """SELECT 'category' AS section, migration_category AS label, count(*) AS n FROM predictions GROUP BY 2
       UNION ALL SELECT 'bucket', CASE WHEN score < 30 THEN 'simple' WHEN score < 60 THEN 'medium' ELSE 'complex' END, count(*) FROM predictions GROUP BY 2
       """
    + " ".join(
        f"""UNION ALL (SELECT '{name}', type, count(DISTINCT job_id) AS n FROM stages WHERE type IN {G.sql_list(types)}
            GROUP BY 2 ORDER BY n DESC, type LIMIT 10)"""
        for name, types in (("source", SOURCES), ("target", TARGETS), ("transform", TRANSFORMS))
    ),
)
def portfolio_report(spark, d):
    s = G.stages(spark, d)
    rows = R.migration_category(R.features(s, G.links(spark, d, s), "job_id"))
    return R.portfolio_report(s, rows, "job_id", 10)


@query(
    "capacity_cost",
    G.FEATURES_SQL + """, c AS (SELECT round(0.5 + (score::DECIMAL(6,1) / 100)::DECIMAL(8,4) + n_stages::DECIMAL(12,0) * 0.05, 2)::DECIMAL(18,2) AS h FROM scored)
       SELECT count(*) AS n_entities, CAST(sum(h) AS DOUBLE) AS capacity_hours, CAST(round(sum(h) * 13.2, 2) AS DOUBLE) AS monthly_cost FROM c""",
)
def capacity_cost(spark, d):
    return R.capacity_cost(features(spark, d))


_UNKNOWN_SQL = """unknown AS (SELECT DISTINCT job_id, type FROM typed WHERE support IS NULL AND type <> '')"""


@query(
    "unknown_rollup",
    G.FEATURES_SQL + f""", {_UNKNOWN_SQL}
       SELECT 'type' AS section, type AS label, count(*) AS n FROM unknown GROUP BY 2
       UNION ALL SELECT 'total', 'unique types', count(DISTINCT type) FROM unknown
       UNION ALL SELECT 'total', 'entities', count(DISTINCT job_id) FROM unknown
       UNION ALL (SELECT 'entity', CAST(job_id AS VARCHAR), count(*) FROM unknown GROUP BY job_id)""",
)
def unknown_rollup(spark, d):
    return R.unknown_rollup(G.stages(spark, d), "job_id")


@query(
    "threshold_rules",
    P + f""", {_UNKNOWN_SQL}, one AS (SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (category = 'AUTO') / count(*), 1) AS auto_pct,
          count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high, CAST(sum(estimated_hours::DECIMAL(18,1)) AS DOUBLE) AS hours,
          count(*) FILTER (contains(migration_category, 'CDC')) AS chg, count(*) FILTER (score >= 60) AS cplx FROM predictions),
       two AS (SELECT count(DISTINCT (job_id, type)) FILTER (is_source AND (contains(type, 'File') OR contains(type, 'Dataset'))) AS files,
          count(DISTINCT (job_id, type)) FILTER (is_source AND contains(type, 'Connector')) AS conns,
          count(DISTINCT (job_id, type)) FILTER (is_transform AND contains(type, 'Lookup')) AS looks,
          count(DISTINCT (job_id, type)) FILTER (is_source AND contains(type, 'Teradata')) AS tera FROM typed)
       SELECT level, rule, CAST(value AS DOUBLE) AS value FROM (
         SELECT 'success' AS level, 'automation high' AS rule, auto_pct AS value FROM one WHERE auto_pct >= 70
         UNION ALL SELECT 'tip', 'automation medium', auto_pct FROM one WHERE auto_pct >= 40 AND auto_pct < 70
         UNION ALL SELECT 'warning', 'automation low', auto_pct FROM one WHERE auto_pct < 40
         UNION ALL SELECT 'warning', 'many high-risk entities', high FROM one WHERE high > 5
         UNION ALL SELECT 'tip', 'unknown step types', count(DISTINCT type) FROM unknown HAVING count(*) > 0
         UNION ALL SELECT 'tip', 'total effort', hours FROM one WHERE hours > 0
         UNION ALL SELECT 'tip', 'file heavy', files FROM one, two WHERE files > n * 0.5
         UNION ALL SELECT 'tip', 'connector heavy', conns FROM one, two WHERE conns > n * 0.3
         UNION ALL SELECT 'tip', 'lookup heavy', looks FROM one, two WHERE looks > n * 0.3
         UNION ALL SELECT 'warning', 'change capture present', chg FROM one WHERE chg > 0
         UNION ALL SELECT 'warning', 'complex entities', cplx FROM one WHERE cplx > n * 0.3
         UNION ALL SELECT 'tip', 'special connector present', tera FROM two WHERE tera > 0)""",
)
def threshold_rules(spark, d):
    from stageloom.operators.rule_tables import FULL, METADATA, PARTIAL

    known = sorted({*FULL, *PARTIAL, *MANUAL, *METADATA})
    s = G.stages(spark, d)
    rows = R.predictions(R.features(s, G.links(spark, d, s), "job_id"))
    per_job = rows.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.round(F.lit(100.0) * F.count_if(F.col("category") == "AUTO") / F.count(F.lit(1)), 1).alias("auto_pct"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_high_risk"),
        F.sum(F.col("estimated_hours").cast("decimal(18,1)")).cast("double").alias("total_hours"),
        F.count_if(F.contains("migration_category", F.lit("CDC"))).alias("n_change"),
        F.count_if(F.col("score") >= 60).alias("n_complex"),
    )
    t = F.col("type")
    has = lambda word: F.contains(t, F.lit(word))
    source, transform = t.isin(SOURCES), t.isin(TRANSFORMS)
    distinct = s.select("job_id", "type").distinct()
    per_type = distinct.agg(
        F.count_if(source & (has("File") | has("Dataset"))).alias("n_files"),
        F.count_if(source & has("Connector")).alias("n_connectors"),
        F.count_if(transform & has("Lookup")).alias("n_lookups"),
        F.count_if(source & has("Teradata")).alias("n_teradata"),
        F.count_distinct(F.when(~t.isin(known) & (t != ""), t)).alias("n_unknown_types"),
    )
    # Two one-row tables side by side.
    summary = per_job.withColumns(
        {c: per_type.select(c).scalar() for c in per_type.columns}
    ).withColumn("effort_reduction", F.lit(None).cast("double"))
    return R.threshold_rules(summary)


_RUN_SQL = """count(*) AS n_runs, count(*) FILTER (o_orderstatus = 'F') AS n_ok, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS success_rate,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_cost FROM orders"""


@query("run_summary", f"SELECT '(all)' AS o_orderpriority, {_RUN_SQL} UNION ALL SELECT o_orderpriority, {_RUN_SQL} GROUP BY 1")
def run_summary(spark, d):
    return R.run_summary(load(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority", "o_totalprice")
