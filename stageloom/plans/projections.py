"""Mapping, filter, routing, key and hash stages over the star schema."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from stageloom.functions.text import safe_name
from stageloom.operators import project as P
from stageloom.operators.custom import custom_rows
from stageloom.operators.custom import GroupLogic
from stageloom.operators.custom import custom_groups as groups
from stageloom.operators.custom import custom_stage as custom
from stageloom.plans.registry import query
from stageloom.tables import load


@query(
    "apply_mapping",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
              CAST(c_acctbal AS DOUBLE) AS balance
       FROM customer""",
)
def apply_mapping(spark, d):
    return P.apply_mapping(
        load(spark, d, "customer"),
        [
            ("c_custkey", "bigint", "customer_id", "string"),
            ("c_name", "string", "customer_name", "string"),
            ("c_acctbal", "decimal(18,2)", "balance", "double"),
        ],
    )


@query(
    "rename_columns",
    "SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier",
)
def rename_columns(spark, d):
    return P.rename(load(spark, d, "supplier"), {"s_suppkey": "supplier_id", "s_name": "supplier"})


@query("copy_stage", "SELECT p_partkey, p_partkey AS part_copy, p_brand FROM part")
def copy_stage(spark, d):
    return P.copy_stage(
        load(spark, d, "part"),
        {"p_partkey": "p_partkey", "part_copy": "p_partkey", "p_brand": "p_brand"},
    )


@query(
    "modify_stage",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate,
              o_orderpriority FROM orders""",
)
def modify_stage(spark, d):
    return P.modify(load(spark, d, "orders"), {"o_orderdate": "date"}, ["o_totalprice"])


@query(
    "column_generator",
    """SELECT s_suppkey, 'batch' AS load_kind, CAST(s_suppkey * 10 AS BIGINT) AS wide_key
       FROM supplier""",
)
def column_generator(spark, d):
    return P.column_generator(
        load(spark, d, "supplier").select("s_suppkey"),
        {"load_kind": F.lit("batch"), "wide_key": F.col("s_suppkey") * 10},
    )


@query("select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_columns(spark, d):
    return P.select_columns(load(spark, d, "lineitem"), ["l_orderkey", "l_quantity"])


@query(
    "filter_chain",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
       WHERE l_quantity > 10 AND l_returnflag = 'R' AND l_discount >= 0.05""",
)
def filter_chain(spark, d):
    return P.filter_all(
        load(spark, d, "lineitem"),
        [F.col("l_quantity") > 10, F.col("l_returnflag") == "R", F.col("l_discount") >= 0.05],
    ).select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "switch_route",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large'
              WHEN o_orderstatus = 'O' THEN 'open'
              WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS route
       FROM orders""",
)
def switch_route(spark, d):
    return P.switch_route(
        load(spark, d, "orders"),
        [
            ("large", F.col("o_totalprice") > 400000),
            ("open", F.col("o_orderstatus") == "O"),
            ("urgent", F.col("o_orderpriority").startswith("1")),
        ],
        "other",
    ).select("o_orderkey", "route")


@query(
    "audit_columns",
    """SELECT n_nationkey, n_name, 'nation' AS _source_table, 'nation.parquet' AS file_name,
              TRUE AS stamped FROM nation""",
)
def audit_columns(spark, d):
    out = P.with_audit(load(spark, d, "nation"), "nation", from_files=True)
    return out.select(
        "n_nationkey",
        "n_name",
        "_source_table",
        F.regexp_extract("_source_file", "[^/]+$", 0).alias("file_name"),
        (F.col("_extracted_at").isNotNull() & F.col("_load_timestamp").isNotNull()).alias("stamped"),
    )


@query(
    "surrogate_key_dense",
    """SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS customer_sk,
              c_custkey FROM customer""",
)
def surrogate_key_dense(spark, d):
    return P.surrogate_key(
        load(spark, d, "customer").select("c_name", "c_custkey"),
        "customer_sk",
        ["c_name", "c_custkey"],
    ).select("customer_sk", "c_custkey")


@query(
    "surrogate_key_continue",
    """SELECT CAST((SELECT max(o_orderkey) FROM orders)
              + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS sk,
              c_custkey FROM customer""",
)
def surrogate_key_continue(spark, d):
    return P.surrogate_key(
        load(spark, d, "customer").select("c_acctbal", "c_custkey"),
        "sk",
        [("c_acctbal", "desc"), "c_custkey"],
        mode="continue",
        existing=load(spark, d, "orders"),
        existing_key="o_orderkey",
    ).select("sk", "c_custkey")


@query(
    "surrogate_key_unique",
    "SELECT count(*) AS n_rows, count(*) AS n_keys, 0::BIGINT AS n_missing, count(DISTINCT c_custkey) AS n_customers FROM customer",
)
def surrogate_key_unique(spark, d):
    """The keys themselves are arbitrary; every row has one and no two share one."""
    keyed = P.surrogate_key(load(spark, d, "customer").select("c_custkey"), "sk", mode="unique")
    return keyed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sk").alias("n_keys"),
        F.count_if(F.col("sk").isNull()).alias("n_missing"), F.count_distinct("c_custkey").alias("n_customers"),
    )


@query(
    "input_row_number",
    """SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS inrownum
       FROM events""",
)
def input_row_number(spark, d):
    return P.row_number_global(
        load(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"]
    ).select("event_id", "inrownum")


DECLARED = [
    {"name": "id", "type": "BigInt"},
    {"name": "name", "type": "VarChar", "length": 12},
    {"name": "balance", "type": "Decimal", "precision": 10, "scale": 2},
    {"name": "segment_no", "type": "Integer"},
]


@query(
    "cast_declared",
    """SELECT c_custkey AS id, left(c_name, 12) AS name,
              CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS balance,
              CAST(NULL AS INTEGER) AS segment_no FROM customer""",
)
def cast_declared(spark, d):
    raw = load(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.col("c_mktsegment").alias("segment_no"),
    )
    return P.cast_declared(raw, DECLARED).withColumn("balance", F.col("balance").cast("double"))


@query(
    "record_hash",
    """SELECT n_nationkey, sha256(concat_ws('|', coalesce(n_name, ''),
              coalesce(CAST(n_regionkey AS VARCHAR), ''))) AS _record_hash FROM nation
       UNION ALL
       SELECT CAST(o_orderkey AS INTEGER), sha256(concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), ''),
              coalesce(o_orderstatus, ''), coalesce(o_orderpriority, ''))) FROM orders""",
)
def record_hash(spark, d):
    nation = P.record_hash(load(spark, d, "nation"), ["n_nationkey"])
    orders = P.record_hash(
        load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        ["o_orderkey"],
    )
    return nation.select("n_nationkey", "_record_hash").unionByName(
        orders.select(F.col("o_orderkey").cast("int").alias("n_nationkey"), "_record_hash")
    )


@query(
    "safe_names",
    r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(n), '[ /\\:*?"<>|]', '_', 'g'), '_+', '_', 'g'),
              '^_|_$', '', 'g') AS as_file,
              regexp_replace(regexp_replace(lower(n), '[^\p{L}\p{N}_]', '_', 'g'), '^([0-9])', 'stage_\1') AS as_variable,
              left(regexp_replace(regexp_replace(lower(n), '[ -]', '_', 'g'), '^([0-9])', 'job_\1'), 255) AS as_job
       FROM (SELECT page_id AS id, url AS n FROM pages UNION ALL SELECT o_orderkey, o_orderpriority FROM orders)""",
)
def safe_names(spark, d):
    names = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("n")).unionByName(
        load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("n"))
    )
    n = F.col("n")
    return names.select(
        "id",
        safe_name(n).alias("as_file"),
        safe_name(n, "variable").alias("as_variable"),
        safe_name(n, "job").alias("as_job"),
    )


@query(
    "filter_in",
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')""",
)
def filter_in(spark, d):
    return P.filter_in(
        load(spark, d, "customer"), "c_mktsegment", "MACHINERY, BUILDING"
    ).select("c_custkey", "c_mktsegment")


@query(
    "filter_in_table",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN
       (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def filter_in_table(spark, d):
    poor = load(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return P.filter_in(load(spark, d, "orders"), "o_custkey", poor).select("o_orderkey")


@query(
    "custom_stage",
    "SELECT p_partkey, CAST(floor(p_retailprice / 100) AS BIGINT) AS band, p_size * 2 AS double_size FROM part",
)
def custom_stage(spark, d):
    """A DataFrame hook after a row hook in Python."""

    def band(pdf):
        return pdf.assign(band=(pdf["p_retailprice"] // 100).astype("int64"))[["p_partkey", "band", "p_size"]]

    parts = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    rows = custom_rows(parts, band, "p_partkey bigint, band bigint, p_size int")
    return custom(rows, lambda df: df.select("p_partkey", "band", (F.col("p_size") * 2).alias("double_size")))


class LongestClimb(GroupLogic):
    """The longest run of rising values; two numbers are all that is kept of a group."""

    def start(self, key):
        self.key, self.last, self.run, self.best, self.n = key, None, 0, 0, 0

    def rows(self, part):
        for value in part.column("value").to_pylist():
            self.run = self.run + 1 if self.last is not None and value > self.last else 1
            self.best, self.last = max(self.best, self.run), value
        self.n += len(part)
        return iter(())

    def end(self):
        yield pa.RecordBatch.from_pylist([{"user_id": self.key["user_id"], "events": self.n, "longest_climb": self.best}])


@query(
    "custom_groups",
    """SELECT user_id, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest_climb FROM (SELECT user_id, run, count(*) AS n FROM (SELECT user_id,
         sum(fall) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *,
           CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fall FROM events)) GROUP BY 1, 2) GROUP BY 1""",
)
def custom_groups(spark, d):
    events = load(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return groups(events, ["user_id"], ["ts", "event_id"], LongestClimb, "user_id long, events long, longest_climb long")
