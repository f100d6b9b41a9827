"""Steps and links derived from the star schema, in Spark and in SQL.

An order is an entity, its lines are steps in a total order; the step type follows
from the brand of the part. Consecutive steps are linked, and lines of a large quantity
hang off the first step as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.operators import rule_tables as T
from stageloom.operators.ordering import ordered_scan
from stageloom.operators.sizing import broadcast_if_small
from stageloom.scratch import materialise
from stageloom.tables import load

# Step type of Brand#1, Brand#2, ...
TYPES = (
    "OracleConnector DB2Connector SequentialFile Dataset Transformer Join Lookup Aggregator Sort "
    "Filter Funnel Copy CTransformerStage CHashedFileStage CSeqFileStage CODBCStage Pivot "
    "ChangeCapture TeradataConnector NetezzaConnector CAnnotation CTrxInput LegacyStage PxLookup "
    "OracleConnectorPX"
).split()

ORDER = (
    "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate "
    "l_returnflag l_linestatus"
).split()


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def stages(spark: SparkSession, d: str) -> DataFrame:
    """job_id, position, name, type, properties, quantity, and the name of the step before."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    types = F.array(*[F.lit(t) for t in TYPES])
    # The type is worked out per part, before the join repeats it per line.
    parts = load(spark, d, "part").select(
        "p_partkey", F.element_at(types, brand).alias("type"), "p_name", "p_type"
    )
    rows = (
        load(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("job_id"), *ORDER)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .drop("p_partkey")
    )
    scan = {"position": ("row_number", None), "before": ("lag", "p_name")}
    numbered = ordered_scan(rows, ["job_id"], ORDER, [scan])
    rows = numbered.select(
        "job_id",
        "position",
        F.concat("p_name", F.lit("_"), F.col("position").cast("string")).alias("name"),
        "type",
        F.create_map(F.lit("TableName"), "p_type", F.lit("Mode"), "l_returnflag").alias("properties"),
        F.col("l_quantity").alias("quantity"),
        F.concat("before", F.lit("_"), (F.col("position") - 1).cast("string")).alias("previous"),
    )
    # Every report reads the steps several times (as steps, as chain, as first steps).
    return materialise(rows, "stages")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """job_id, position and type of ``stages``, for queries that read nothing else of them.

    A part has one type, so lines of a job that tie in number and part have the same one and the other columns of
    ORDER cannot change which type stands where; they are not shuffled.
    """
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand")
    parts = load(spark, d, "part").select("p_partkey", brand)
    small = broadcast_if_small(parts)
    # A file of parts unpacks to many times its size, by which Catalyst would broadcast it.
    parts = parts.hint("merge") if small is parts else small
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), *ORDER[:2])
    rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    # Read for the large jobs and for the order.
    rows = materialise(rows, "lines")
    numbered = ordered_scan(rows, ["job_id"], ORDER[:2], [{"position": ("row_number", None)}])
    types = F.array(*[F.lit(t) for t in TYPES])
    return materialise(numbered.select("job_id", "position", F.element_at(types, F.col("brand")).alias("type")), "steps")


def links(spark: SparkSession, d: str, all_stages: DataFrame | None = None) -> DataFrame:
    """job_id, from_stage, to_stage."""
    s = stages(spark, d) if all_stages is None else all_stages
    chain = s.where("position > 1").select("job_id", F.col("previous").alias("from_stage"), F.col("name").alias("to_stage"))
    first = s.where("position = 1").select("job_id", F.col("name").alias("from_stage"))
    fan = (
        s.where("position > 2 AND quantity > 25")
        .select("job_id", F.col("name").alias("to_stage"))
        .join(first, "job_id")
    )
    return chain.unionByName(fan)


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()


_TYPE_ARRAY = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"

STAGES_SQL = f"""stages AS MATERIALIZED (SELECT job_id, position, p_name || '_' || position AS name, type, p_type, l_returnflag, l_quantity AS quantity
  FROM (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS position,
               {_TYPE_ARRAY}[CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)] AS type, p_name, p_type, l_returnflag, l_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""

LINKS_SQL = """links AS MATERIALIZED (SELECT job_id, from_stage, name AS to_stage FROM
    (SELECT *, lag(name) OVER (PARTITION BY job_id ORDER BY position) AS from_stage FROM stages) WHERE position > 1
  UNION ALL SELECT s.job_id, f.name, s.name FROM stages s JOIN stages f ON f.job_id = s.job_id AND f.position = 1
  WHERE s.position > 2 AND s.quantity > 25)"""


def _rules_values() -> str:
    rows = []
    for t, w, support, effort, src, tgt, tr in T.type_rules():
        s = f"'{support}'" if support else "NULL"
        rows.append(f"('{t}', {w}, {s}, {effort}::DECIMAL(10,1), {src}, {tgt}, {tr})")
    return ", ".join(rows)


FEATURES_SQL = f"""WITH {STAGES_SQL}, {LINKS_SQL},
rules(rt, weight, support, effort, is_source, is_target, is_transform) AS (VALUES {_rules_values()}),
typed AS (SELECT * FROM stages LEFT JOIN rules ON type = rt),
per_job AS (SELECT job_id, count(*) AS n_stages, CAST(sum(coalesce(weight, 2)) AS BIGINT) AS weight,
   count(*) FILTER (support = 'full') AS n_full, count(*) FILTER (support = 'partial') AS n_partial,
   count(*) FILTER (support = 'manual') AS n_manual, count(*) FILTER (support IS NULL AND type <> '') AS n_unknown,
   sum(coalesce(effort, 1.0)) AS effort, count(*) FILTER (contains(type, 'Lookup')) AS n_lookups,
   count(*) FILTER (is_transform) AS n_transforms, count(*) FILTER (type = 'Transformer') AS n_transformers,
   coalesce(bool_or(is_source), false) AS any_source, coalesce(bool_or(is_target), false) AS any_target,
   coalesce(bool_or(is_source AND (contains(type, 'File') OR contains(type, 'Dataset'))), false) AS file_source,
   coalesce(bool_or(is_target AND (contains(type, 'File') OR contains(type, 'Dataset'))), false) AS file_target,
   coalesce(bool_or(is_source AND contains(type, 'Connector')), false) AS connector_source,
   coalesce(bool_or(is_transform AND contains(type, 'Change')), false) AS change_transform,
   bool_or(contains(type, 'Change')) AS any_change, bool_or(contains(type, 'Teradata')) AS any_teradata,
   bool_or(contains(type, 'Netezza')) AS any_netezza, bool_or(contains(type, 'Pivot')) AS any_pivot,
   bool_or(contains(type, 'Connector')) AS any_connector,
   bool_or(contains(type, 'File') OR contains(type, 'Dataset')) AS any_file,
   bool_or(contains(type, 'Oracle') OR contains(type, 'DB2') OR contains(type, 'SQLServer')) AS any_jdbc
   FROM typed GROUP BY 1),
branches AS (SELECT job_id, CAST(sum(o) AS BIGINT) AS n_links, count(*) FILTER (o > 1) AS n_branches, count(*) FILTER (o > 2) AS n_complex_branches
   FROM (SELECT job_id, from_stage, count(*) AS o FROM links GROUP BY 1, 2) GROUP BY 1),
features AS (SELECT * EXCLUDE (n_links, n_branches, n_complex_branches), coalesce(n_links, 0) AS n_links, coalesce(n_branches, 0) AS n_branches,
   coalesce(n_complex_branches, 0) AS n_complex_branches FROM per_job LEFT JOIN branches USING (job_id)),
scored AS (SELECT *, least(least(n_stages * 2, 30) + weight + least(n_links * 1.5::DOUBLE, 20.0::DOUBLE) + least(n_branches * 3, 10), 100.0::DOUBLE) AS score
   FROM features)
"""

PREDICTIONS_SQL = FEATURES_SQL + """, c1 AS (SELECT *,
  CASE WHEN file_source AND file_target AND score < 20 THEN 'AUTO - S3 to S3 ETL'
       WHEN any_source AND NOT any_target AND score < 30 THEN 'AUTO - Read-Only (Athena candidate)'
       WHEN connector_source AND score < 40 AND n_transforms < 3 THEN 'AUTO - Simple JDBC ETL'
       WHEN change_transform THEN 'MANUAL - CDC/SCD Pattern (Delta Lake)'
       WHEN n_transforms > 5 OR score > 70 THEN 'MANUAL - Complex Transformations'
       WHEN score < 30 THEN 'AUTO - Basic Glue Job' WHEN score < 50 THEN 'SEMI-AUTO - Standard ETL'
       WHEN score < 70 THEN 'SEMI-AUTO - Advanced ETL' ELSE 'MANUAL - Complex Job' END AS migration_category,
  (n_full + n_partial * 0.5::DOUBLE) / n_stages AS automation_ratio,
  least((CASE WHEN n_lookups > 2 THEN 20 ELSE 0 END) + (CASE WHEN any_change THEN 30 ELSE 0 END)
    + (CASE WHEN n_complex_branches > 0 THEN 15 ELSE 0 END) + (CASE WHEN any_teradata THEN 15 ELSE 0 END)
    + (CASE WHEN any_netezza THEN 15 ELSE 0 END) + (CASE WHEN score > 80 THEN 10 ELSE 0 END)
    + (CASE WHEN any_pivot THEN 10 ELSE 0 END), 100) AS risk_points,
  concat_ws(chr(10), CASE WHEN n_lookups > 2 THEN 'Multiple lookups (' || n_lookups || ') - complex data enrichment' END,
    CASE WHEN any_change THEN 'CDC/SCD pattern detected - requires Glue Bookmarks + custom logic' END,
    CASE WHEN n_complex_branches > 0 THEN 'Complex branching (' || n_complex_branches || ' multi-output stages)' END,
    CASE WHEN any_teradata THEN 'Teradata connector - requires custom JDBC configuration' END,
    CASE WHEN any_netezza THEN 'Netezza connector - legacy system, verify compatibility' END,
    CASE WHEN score > 80 THEN 'High complexity score (' || score || '/100)' END,
    CASE WHEN any_pivot THEN 'Pivot transformation - requires DataFrame API' END) AS factors
  FROM scored),
c2 AS (SELECT *, risk_points / 100.0::DOUBLE AS risk FROM c1),
c3 AS (SELECT *, CASE WHEN n_manual > 0 OR risk_points > 40 THEN 'MANUAL'
    WHEN automation_ratio > 0.8::DOUBLE AND score < 40 AND risk_points < 20 THEN 'AUTO'
    WHEN automation_ratio > 0.6::DOUBLE AND score < 60 THEN 'SEMI_AUTO' WHEN score > 70 THEN 'MANUAL' ELSE 'SEMI_AUTO' END AS category,
  CASE WHEN n_manual > 0 OR risk_points > 40 THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * risk)
    WHEN automation_ratio > 0.8::DOUBLE AND score < 40 AND risk_points < 20 THEN least(0.95::DOUBLE, automation_ratio - risk)
    WHEN automation_ratio > 0.6::DOUBLE AND score < 60 THEN least(0.9::DOUBLE, 0.5::DOUBLE + 0.3::DOUBLE * automation_ratio - 0.2::DOUBLE * risk)
    ELSE 0.6::DOUBLE END AS confidence,
  greatest(0.1::DOUBLE, least(0.99::DOUBLE, 0.85::DOUBLE + automation_ratio * 0.15::DOUBLE - risk * 0.3::DOUBLE
    - score / 100.0::DOUBLE * 0.2::DOUBLE - n_unknown / n_stages * 0.1::DOUBLE)) AS success_probability
  FROM c2),
predictions AS (SELECT *, CAST(round(CAST((effort + 2) * (1 + CAST(score AS DECIMAL(6,1)) / 100)::DECIMAL(8,4)
    * (CASE category WHEN 'AUTO' THEN 0.5 WHEN 'MANUAL' THEN 2.0 ELSE 1.0 END)::DECIMAL(2,1) AS DECIMAL(18,6)), 1) AS DOUBLE) AS estimated_hours,
  CASE WHEN any_change OR risk_points > 60 THEN 'CRITICAL' WHEN risk_points > 40 THEN 'HIGH' WHEN risk_points > 20 THEN 'MEDIUM'
    ELSE 'LOW' END AS risk_level FROM c3)
"""
