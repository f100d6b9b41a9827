"""Exported job files written from the star schema, read back, checked and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.operators import quality as Q
from stageloom.operators.joins import LookupSpec, lookup
from stageloom.operators.rules import features
from stageloom.plans import fleet as G
from stageloom.plans.registry import query
from stageloom.scratch import new_path
from stageloom.sources import files as R
from stageloom.sources import jobs as J
from stageloom.sources import sinks as K
from stageloom.tables import load

#: Step types of the fleet that an export may hold; the others are written as custom stages.
RECORD_TYPES = ["CTransformerStage", "CHashedFileStage", "CSeqFileStage", "CODBCStage"]
EXPORT_SQL = f"""WITH {G.STAGES_SQL.replace("stages AS MATERIALIZED", "every AS MATERIALIZED")},
  stages AS (SELECT * REPLACE (CASE WHEN type IN {G.sql_list(RECORD_TYPES)} THEN type ELSE 'CCustomStage' END AS type) FROM every), {G.LINKS_SQL}"""


def _record_type() -> F.Column:
    return F.when(F.col("type").isin(RECORD_TYPES), F.col("type")).otherwise("CCustomStage")


def exported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Steps with the types that an export knows, and links."""
    s = G.stages(spark, d)
    return s.withColumn("type", _record_type()), G.links(spark, d, s)


#: Jobs of one file.
JOBS_PER_FILE = 1000


def _file_of(job_id: F.Column) -> F.Column:
    return F.floor(job_id / JOBS_PER_FILE).alias("file")


def _documents(jobs: DataFrame, root: str, path: str, packed: bool = False) -> None:
    """(file, value) elements as one XML file each ``file``, below one root element."""
    files = jobs.groupBy("file").agg(
        F.concat(F.lit(f"<{root}>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"\n</{root}>")).alias("value")
    )
    writer = files.write.partitionBy("file")
    (writer.option("compression", "gzip") if packed else writer).text(path)


def _attribute(name: str, value) -> F.Column:
    return F.concat(F.lit(f' {name}="'), value, F.lit('"'))


def _element(name: str, value) -> F.Column:
    return F.concat(F.lit(f'<Property Name="{name}">'), value, F.lit("</Property>"))


def _chained(steps: F.Column, link: Callable[[F.Column, F.Column], F.Column]) -> F.Column:
    """The links of a job as ``fleet.links`` has them, each made by ``link(from, to)``, from its steps in order."""
    chain = F.transform(
        F.filter(steps, lambda s: s["position"] > 1), lambda s: link(s["previous"], s["name"])
    )
    fan = F.transform(
        F.filter(steps, lambda s: (s["position"] > 2) & (s["quantity"] > 25)), lambda s: link(steps[0]["name"], s["name"])
    )
    return F.concat(chain, fan)


def write_xml(spark: SparkSession, d: str) -> str:
    """One Job element per order, odd ones gzipped in a subfolder; one file whose only job is broken.

    Steps are shuffled once, by file; a job's links follow from its steps.
    """
    stages = G.stages(spark, d).withColumn("type", _record_type())
    record = F.concat(
        F.lit("<Record"), _attribute("Identifier", F.col("name")), _attribute("Type", F.col("type")), F.lit(">"),
        _element("TableName", F.col("properties")["TableName"]), F.lit("</Record>"),
    )
    link = lambda a, b: F.concat(
        F.lit("<Record"), _attribute("Identifier", F.lit("link")), _attribute("Type", F.lit("CDSLink")), F.lit(">"),
        _element("FromStage", a), _element("ToStage", b), F.lit("</Record>"),
    )
    step = F.struct("position", "name", "previous", "quantity", record.alias("r"))
    # Even and odd jobs keep apart, so that a task has whole files of one kind.
    rows = stages.select("job_id", _file_of(F.col("job_id")), (F.col("job_id") % 2).alias("odd"), step.alias("step"))
    steps = rows.repartition("file", "odd").groupBy("file", "odd", "job_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    name = _attribute("Identifier", F.col("job_id").cast("string"))
    lines = F.concat(F.col("steps.r"), F.sort_array(_chained(F.col("steps"), link)))
    jobs = steps.select("file", "odd", "job_id", F.concat(F.lit("<Job"), name, F.lit(">"), F.array_join(lines, ""), F.lit("</Job>")).alias("value"))
    path = new_path(spark, "export")
    _documents(jobs.where("odd = 0"), "DSExport", f"{path}/plain")
    _documents(jobs.where("odd <> 0"), "DSExport", f"{path}/deep/packed", packed=True)
    oops = F.concat(F.lit('<Job Identifier="'), F.col("job_id").cast("string"), F.lit('"><Record Identifier="x" Type="C"><Oops></Record></Job>'))
    first = stages.agg(F.min("job_id").alias("job_id"))
    _documents(first.select(_file_of(F.col("job_id")), oops.alias("value")), "DSExport", f"{path}/bad")
    return path


@query(
    "job_xml_stages",
    EXPORT_SQL + " SELECT job_id::VARCHAR AS job_id, CAST(position - 1 AS INTEGER) AS position, name, type, p_type AS table_name FROM stages",
)
def job_xml_stages(spark, d):
    stages = J.read_job_xml(spark, write_xml(spark, d))["stages"]
    return stages.select("job_id", "position", "name", "type", F.col("properties")["TableName"].alias("table_name"))


@query("job_xml_links", EXPORT_SQL + " SELECT job_id::VARCHAR AS job_id, from_stage, to_stage FROM links")
def job_xml_links(spark, d):
    return J.read_job_xml(spark, write_xml(spark, d))["links"].select("job_id", "from_stage", "to_stage")


@query(
    "job_xml_files",
    EXPORT_SQL + """ SELECT CASE WHEN job_id % 2 = 1 THEN 'packed' ELSE 'plain' END AS folder, count(DISTINCT job_id) AS n_jobs, 0::BIGINT AS n_errors
       FROM stages GROUP BY 1 UNION ALL SELECT 'bad', 0, 1""",
)
def job_xml_files(spark, d):
    """Files found at any depth, compressed or not; a broken one gives an error row."""
    out = J.read_job_xml(spark, write_xml(spark, d), "part-*")
    folder = F.element_at(F.split("path", "/"), -3).alias("folder")
    seen = out["jobs"].select(folder, F.lit(0).alias("error")).unionByName(out["errors"].select(folder, F.lit(1).alias("error")))
    return seen.groupBy("folder").agg(F.count_if(F.col("error") == 0).alias("n_jobs"), F.sum("error").alias("n_errors"))


@query(
    "job_xml_scores",
    G.FEATURES_SQL.replace(f"WITH {G.STAGES_SQL}, {G.LINKS_SQL}", EXPORT_SQL) + "SELECT job_id::VARCHAR AS job_id, n_stages, n_links, score FROM scored",
)
def job_xml_scores(spark, d):
    """From export files to scores."""
    out = J.read_job_xml(spark, write_xml(spark, d))
    return features(out["stages"], out["links"], "job_id").select("job_id", "n_stages", "n_links", "score")


@query(
    "job_older_xml",
    EXPORT_SQL + """ SELECT job_id::VARCHAR AS job_id, CAST(position - 1 AS INTEGER) AS position, name, type, l_returnflag AS mode,
       coalesce(n, 0) AS n_links FROM stages LEFT JOIN (SELECT job_id, count(*) AS n FROM links GROUP BY 1) USING (job_id)""",
)
def job_older_xml(spark, d):
    stages, links = exported(spark, d)
    stage = F.concat(
        F.lit("<STAGE"), _attribute("NAME", F.col("name")), _attribute("STGTYPE", F.col("type")),
        F.lit('><PROPERTY NAME="Mode">'), F.col("properties")["Mode"], F.lit("</PROPERTY></STAGE>"),
    )
    link = F.concat(
        F.lit("<LINK"), _attribute("FROMSTAGE", F.col("from_stage")), _attribute("TOSTAGE", F.col("to_stage")), F.lit("/>")
    )
    rows = stages.select("job_id", F.col("position").alias("at"), stage.alias("r")).unionByName(
        links.select("job_id", F.lit(1 << 40).alias("at"), link.alias("r"))
    )
    body = F.array_join(F.sort_array(F.collect_list(F.struct("at", "r")))["r"], "")
    name = _attribute("NAME", F.col("job_id").cast("string"))
    path = new_path(spark, "older")
    jobs = rows.groupBy("job_id").agg(body.alias("b"))
    jobs = jobs.select(_file_of(F.col("job_id")), F.concat(F.lit("<JOB"), name, F.lit(">"), "b", F.lit("</JOB>")).alias("value"))
    _documents(jobs, "ROOT", path, packed=True)
    out = J.read_older_xml(spark, path)
    counts = out["links"].groupBy("job_id").agg(F.count(F.lit(1)).alias("n_links"))
    return out["stages"].join(counts, "job_id", "left").select(
        "job_id", "position", "name", "type", F.col("properties")["Mode"].alias("mode"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


@query(
    "job_blocks",
    EXPORT_SQL + """ SELECT job_id::VARCHAR AS job_id, CAST(position - 1 AS INTEGER) AS position, name, type FROM stages
       WHERE job_id <> (SELECT min(job_id) FROM stages) UNION ALL SELECT 'errors', 0, NULL, NULL""",
)
def job_blocks(spark, d):
    """Block text of all orders; the first one's block lacks its end and gives the error row."""
    stages, _ = exported(spark, d)
    record = F.concat(
        F.lit('  BEGIN DSRECORD\n    Identifier "'), "name", F.lit('"\n    OLEType "'), "type", F.lit('"\n  END DSRECORD')
    )
    bodies = stages.groupBy("job_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("position", record.alias("r"))))["r"], "\n").alias("b")
    )
    first = bodies.agg(F.min("job_id")).scalar()
    end = F.when(F.col("job_id") == first, "").otherwise("\nEND DSJOB")
    path = new_path(spark, "blocks")
    blocks = bodies.select(F.concat(F.lit('BEGIN DSJOB\n  Identifier "'), F.col("job_id").cast("string"), F.lit('"\n'), "b", end).alias("value"))
    blocks.write.text(path)
    out = J.read_job_blocks(spark, path)
    errors = out["errors"].select(F.lit("errors").alias("job_id"), F.lit(0).alias("position"))
    return out["stages"].select("job_id", "position", "name", "type").unionByName(errors, allowMissingColumns=True)


@query(
    "scan_corrupt",
    """SELECT 'good' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer WHERE c_custkey % 50 <> 0
       UNION ALL SELECT 'bad', count(*), NULL FROM customer WHERE c_custkey % 50 = 0""",
)
def scan_corrupt(spark, d):
    """Lines whose key is no number come back as error rows."""
    path = new_path(spark, "corrupt")
    key = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("x"), F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string"))
    K.write_format(load(spark, d, "customer").select(key.alias("id"), "c_name"), path, "csv")
    good, errors = R.split_corrupt(R.read_delimited(spark, path, "id bigint, c_name string", keep_corrupt=True))
    n = F.count(F.lit(1)).alias("n")
    return good.agg(F.lit("good").alias("part"), n, F.sum("id").alias("total")).unionByName(
        errors.agg(F.lit("bad").alias("part"), n, F.lit(None).cast("bigint").alias("total"))
    )


@query("scan_gzip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_gzip(spark, d):
    path = new_path(spark, "gzip")
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return R.read_delimited(spark, path, rows.schema)


@query("scan_grouped", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_grouped(spark, d):
    """Many small files in nested folders, read by a few tasks."""
    path = new_path(spark, "small")
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for status, name in (("o_orderstatus = 'F'", "a/f"), ("o_orderstatus <> 'F' OR o_orderstatus IS NULL", "b")):
        rows.where(status).repartition(20).write.parquet(f"{path}/{name}")
    return R.read_grouped(spark, path, group_bytes=32 << 20)


@query("write_table", "SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def write_table(spark, d):
    """A bucketed catalog table: grouping by the bucket column needs no shuffle."""
    name = new_path(spark, "t").rsplit("/", 1)[1].replace("-", "_")
    rows = load(spark, d, "customer").select("c_nationkey", "c_custkey")
    K.write_table(rows.where("c_custkey % 2 = 0"), name, bucket_by=["c_nationkey"], buckets=4)
    K.write_table(rows.where("c_custkey % 2 = 1 OR c_custkey IS NULL"), name, bucket_by=["c_nationkey"], buckets=4)
    return R.read_table(spark, name).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


@query(
    "lookup_cached",
    """SELECT 'customer' AS side, c_custkey AS id, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT 'supplier', s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def lookup_cached(spark, d):
    """One stored reference table for two outputs."""
    spec = LookupSpec("nation", load(spark, d, "nation"), "key", "n_nationkey", ["n_name"], cache=True)
    sides = []
    for table, p in (("customer", "c"), ("supplier", "s")):
        rows = load(spark, d, table).select(
            F.lit(table).alias("side"), F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").alias("id"), F.col(f"{p}_nationkey").alias("key")
        )
        sides.append(lookup(rows, spec).select("side", "id", F.col("nation_n_name").alias("nation")))
    return sides[0].unionByName(sides[1])


@query(
    "check_schema",
    """SELECT 'o_orderkey' AS column_name, 'bigint' AS expected, 'bigint' AS actual, 'PASS' AS status, count(*) AS n_rows FROM orders
       UNION ALL SELECT 'o_totalprice', 'decimal(18,2)', 'double', 'FAIL', count(*) FROM orders
       UNION ALL SELECT 'o_comment', 'string', NULL, 'FAIL', count(*) FROM orders""",
)
def check_schema(spark, d):
    orders = load(spark, d, "orders")
    expected = {"o_orderkey": "bigint", "o_totalprice": "decimal(18,2)", "o_comment": "string"}
    return Q.check_schema(orders, expected).withColumn("n_rows", orders.agg(F.count(F.lit(1))).scalar())
