"""Sources, sinks, change handling and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stageloom.operators import cdc as C
from stageloom.operators import quality as Q
from stageloom.plans.joins import CHANGES_SQL, source_and_target
from stageloom.plans.projections import DECLARED
from stageloom.plans.registry import query
from stageloom.scratch import materialise, new_path
from stageloom.sources import deltas as D
from stageloom.sources import files as R
from stageloom.sources import sinks as K
from stageloom.tables import load


@query("scan_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_delimited(spark, d):
    path = new_path(spark, "csv")
    rows = load(spark, d, "customer")
    K.write_format(rows, path, "csv")
    return R.read_delimited(spark, path, rows.schema)


@query("scan_columnar", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 40")
def scan_columnar(spark, d):
    return R.read_columnar(spark, f"{d}/part.parquet").where("p_size > 40").select("p_partkey", "p_brand", "p_size")


@query(
    "scan_partition_pruned",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
)
def scan_partition_pruned(spark, d):
    path = new_path(spark, "by_status")
    K.write_partitioned(
        load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"]
    )
    spark.read.parquet(path).createOrReplaceTempView("orders_by_status")
    return R.read_table(spark, "orders_by_status", "o_orderstatus = 'F'")


@query(
    "keyed_source",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
         ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def keyed_source(spark, d):
    return R.keyed_source(
        load(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]
    ).drop("ts")


@query(
    "row_generator",
    "SELECT range AS id, range * 7 % 13 AS code FROM range(0, (SELECT CAST(count(*) AS BIGINT) FROM orders))",
)
def row_generator(spark, d):
    """As many rows as there are orders."""
    n = load(spark, d, "orders").count()
    return R.row_generator(spark, n, {"id": F.col("id"), "code": F.col("id") * 7 % 13})


@query("incremental_read", "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('hour', ts) END AS ts FROM events")
def incremental_read(spark, d):
    """Four reads of a source in which rows arrive late with the last key, and rows without a key arrive all the time."""
    events = load(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.date_trunc("hour", "ts")).alias("ts"))
    # A row arrives with its third of the days; one in seven of the last hour, and of those without a key, a read later.
    late = (F.col("event_id") % 7 == 0).cast("int")
    day = F.coalesce(F.floor((F.dayofmonth("ts") - 1) / 10), F.col("event_id") % 3)
    arrived = materialise(events.withColumn("read", F.least(F.lit(3), day + late * F.col("ts").isNull().cast("int"))), "arrivals")
    last_hours = arrived.groupBy("read").agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select("ts", F.lit(True).alias("last"))
    arrived = arrived.join(F.broadcast(last_hours), "ts", "left")
    arrived = arrived.withColumn("read", F.when(F.col("last"), F.col("read") + late).otherwise(F.col("read")))
    seen, last, parts = None, None, []
    for read in range(5):
        fresh, last = R.incremental_read(arrived.where(F.col("read") <= read).select("event_id", "ts"), "ts", last, seen)
        parts.append(materialise(fresh, "read"))
        seen = materialise(R.bookmark_rows(parts[-1], "ts", last, seen), "bookmark")
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("write_partitioned", "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def write_partitioned(spark, d):
    path = new_path(spark, "by_flag")
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    K.write_partitioned(rows, path, ["l_returnflag"])
    return spark.read.parquet(path)


@query("write_delimited", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_delimited(spark, d):
    path = new_path(spark, "csv")
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    K.write_format(rows, path, "csv")
    return R.read_delimited(spark, path, rows.schema)


@query(
    "insert_select",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def insert_select(spark, d):
    target = load(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    source = load(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return C.insert_select(target, source, ["id", "name"])


@query(
    "merge_upsert",
    CHANGES_SQL + """SELECT coalesce(tgt.c_custkey, src.c_custkey) AS c_custkey, coalesce(tgt.c_name, src.c_name) AS c_name,
       CASE WHEN src.c_custkey IS NOT NULL THEN src.c_acctbal ELSE tgt.c_acctbal END AS c_acctbal
       FROM tgt FULL JOIN src ON tgt.c_custkey = src.c_custkey""",
)
def merge_upsert(spark, d):
    src, tgt = source_and_target(spark, d)
    keep = ["c_custkey", "c_name", "c_acctbal"]
    return C.merge_upsert(tgt.select(*keep), src.select(*keep), ["c_custkey"], ["c_acctbal"])


UPSERT_SQL = """WITH runs AS (SELECT *, event_id % 4 AS run FROM events), last AS (
    SELECT user_id, event_type, event_id, value, run FROM runs
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY run DESC, event_id DESC) = 1)
  SELECT user_id, event_type, event_id, value FROM last WHERE NOT (run = 3 AND value < 20)"""


def upserted(spark, d):
    """Four upserts, the last of which also removes the keys whose event has a small value."""
    base = new_path(spark, "deltas")
    events = load(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    for run in range(4):
        part = C.latest_per_key(events.where(F.col("event_id") % 4 == run), ["user_id", "event_type"], ["event_id"])
        part = part.withColumn("gone", F.lit(run == 3) & (F.col("value") < 20))
        D.upsert(part, base, ["user_id", "event_type"], deleted="gone")
    return base


@query("upsert_delta", UPSERT_SQL)
def upsert_delta(spark, d):
    return D.read(spark, upserted(spark, d))


@query("upsert_compact", UPSERT_SQL)
def upsert_compact(spark, d):
    """The same table after its deltas were folded into buckets, which split until each has few rows."""
    base = upserted(spark, d)
    D.compact(spark, base, rows_per_bucket=300)
    return D.read(spark, base)


LOAD_COLUMNS = [
    {"name": "user_id", "type": "BigInt", "nullable": False},
    {"name": "kind", "type": "VarChar", "length": 5},
    {"name": "k", "type": "Integer", "default": -1},
]
LOAD_SQL = """FROM (SELECT CASE WHEN event_type <> 'error' THEN user_id END AS user_id, left(event_type, 5) AS kind,
  CASE WHEN floor(value) < 200 THEN CAST(floor(value) AS INTEGER) ELSE -1 END AS k FROM events)"""


@query(
    "load_declared",
    f"""SELECT user_id, kind, k, CASE WHEN user_id IS NULL THEN 'null user_id' WHEN rn > 1 THEN 'duplicate key' ELSE 'ok' END AS outcome
        FROM (SELECT user_id, kind, k, row_number() OVER (PARTITION BY user_id, kind, k) AS rn {LOAD_SQL})""",
)
def load_declared(spark, d):
    raw = load(spark, d, "events").select(
        F.when(F.col("event_type") != "error", F.col("user_id")).cast("string").alias("user_id"),
        F.col("event_type").alias("kind"),
        F.when(F.floor("value") < 200, F.floor("value")).cast("string").alias("k"),
    )
    good, rejects = K.load_declared(raw, LOAD_COLUMNS, ["user_id", "kind", "k"])
    return good.withColumn("outcome", F.lit("ok")).unionByName(
        rejects.withColumnRenamed("reason", "outcome")
    )


@query("set_table", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_table(spark, d):
    return K.write_set(load(spark, d, "lineitem").select("l_partkey", "l_suppkey"))


@query(
    "stage_then_load",
    """SELECT c_custkey AS id, left(c_name, 12) AS name, CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS balance,
              CAST(c_nationkey AS INTEGER) AS segment_no FROM customer""",
)
def stage_then_load(spark, d):
    staged = K.stage_raw(
        load(spark, d, "customer").selectExpr(
            "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_nationkey AS segment_no"
        ),
        ["id", "name", "balance", "segment_no"],
    )
    good, _ = K.load_declared(staged, DECLARED)
    return good.withColumn("balance", F.col("balance").cast("double"))


@query(
    "export_flat",
    "SELECT p_partkey, replace(p_name, ' ', '; ') AS words, p_size FROM part",
)
def export_flat(spark, d):
    return K.flatten_arrays(
        load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"), "p_size")
    )


@query(
    "export_json",
    """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","customers":' || n || '}' AS json
       FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""",
)
def export_json(spark, d):
    counts = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    rows = load(spark, d, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"))
    return K.export_json(rows.select("n_nationkey", "n_name", "customers"))


@query(
    "overwrite_version",
    "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier",
)
def overwrite_version(spark, d):
    base = new_path(spark, "versions")
    K.overwrite(load(spark, d, "supplier").select("s_suppkey", "s_acctbal"), base)
    K.overwrite(K.read_current(spark, base).withColumn("s_acctbal", F.col("s_acctbal") * 2), base)
    return K.read_current(spark, base)


@query(
    "change_capture",
    CHANGES_SQL + """SELECT coalesce(src.c_custkey, tgt.c_custkey) AS c_custkey,
       CASE WHEN src.c_custkey IS NULL THEN tgt.c_acctbal ELSE src.c_acctbal END AS c_acctbal,
       CASE WHEN tgt.c_custkey IS NULL THEN 'insert' WHEN src.c_custkey IS NULL THEN 'not_in_source'
            WHEN src.c_acctbal IS DISTINCT FROM tgt.c_acctbal THEN 'update' ELSE 'unchanged' END AS change
       FROM tgt FULL JOIN src ON tgt.c_custkey = src.c_custkey""",
)
def change_capture(spark, d):
    src, tgt = source_and_target(spark, d)
    return C.change_capture(tgt, src, ["c_custkey"], ["c_acctbal"])


@query(
    "change_apply",
    CHANGES_SQL + """SELECT c_custkey, c_acctbal FROM src UNION ALL SELECT c_custkey, c_acctbal FROM tgt
       WHERE c_custkey NOT IN (SELECT c_custkey FROM src)""",
)
def change_apply(spark, d):
    src, tgt = source_and_target(spark, d)
    return C.change_apply(tgt, src, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("change_initial_load", CHANGES_SQL + "SELECT c_custkey, c_acctbal FROM src")
def change_initial_load(spark, d):
    src, _ = source_and_target(spark, d)
    return C.change_apply(None, src, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query(
    "cdc_metadata",
    CHANGES_SQL + "SELECT c_custkey, TIMESTAMP '2024-02-01 00:00:00' AS _cdc_timestamp, 'UPSERT' AS _cdc_operation FROM src",
)
def cdc_metadata(spark, d):
    src, _ = source_and_target(spark, d)
    return C.with_cdc_meta(src, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select(
        "c_custkey", "_cdc_timestamp", "_cdc_operation"
    )


@query(
    "scd2",
    CHANGES_SQL + """, m AS (SELECT tgt.c_custkey AS tk, src.c_custkey AS sk, tgt.c_acctbal AS tb, src.c_acctbal AS sb
         FROM tgt FULL JOIN src ON tgt.c_custkey = src.c_custkey)
       SELECT tk AS c_custkey, tb AS c_acctbal, DATE '2023-01-01' AS effective_start_date,
              CASE WHEN sk IS NOT NULL AND tb <> sb THEN DATE '2024-02-01' ELSE DATE '9999-12-31' END AS effective_end_date,
              sk IS NULL OR tb = sb AS is_current FROM m WHERE tk IS NOT NULL
       UNION ALL SELECT sk, sb, DATE '2024-02-01', DATE '9999-12-31', TRUE FROM m WHERE sk IS NOT NULL AND (tk IS NULL OR tb <> sb)""",
)
def scd2(spark, d):
    src, tgt = source_and_target(spark, d)
    keep = ["c_custkey", "c_acctbal"]
    dim = C.scd2_initial(tgt.select(*keep), F.lit("2023-01-01"))
    return C.scd2(dim, src.select(*keep), ["c_custkey"], ["c_acctbal"], F.lit("2024-02-01"))


@query(
    "cdc_run",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
         ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def cdc_run(spark, d):
    """Two runs: what came up to the middle of the month, then all the rest."""
    base = new_path(spark, "cdc")
    events = load(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    early = events.where(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    for source in (early, events):
        C.cdc_run(source, base, ["user_id", "event_type"], "ts", ["ts", "event_id"])
    return K.read_current(spark, f"{base}/target").drop("ts")


@query("check_not_empty", "SELECT 'not_empty' AS check_name, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n_rows FROM lineitem")
def check_not_empty(spark, d):
    return Q.check_not_empty(load(spark, d, "lineitem"))


@query(
    "check_null_keys",
    """WITH j AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey)
       SELECT 'c_custkey' AS key_column, n AS n_nulls, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status
       FROM (SELECT count(*) FILTER (c_custkey IS NULL) AS n FROM j)
       UNION ALL SELECT 'o_orderkey', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END
       FROM (SELECT count(*) FILTER (o_orderkey IS NULL) AS n FROM j)""",
)
def check_null_keys(spark, d):
    partial = load(spark, d, "orders").where("o_orderstatus = 'P'")
    joined = load(spark, d, "customer").join(partial, F.col("c_custkey") == F.col("o_custkey"), "left")
    return Q.check_null_keys(joined, ["c_custkey", "o_orderkey"])


@query(
    "check_row_preserving",
    """SELECT (SELECT count(*) FROM orders) AS n_before, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_acctbal > 0) AS n_after, 'FAIL' AS status""",
)
def check_row_preserving(spark, d):
    orders = load(spark, d, "orders")
    good = load(spark, d, "customer").where("c_acctbal > 0")
    return Q.check_row_preserving(orders, orders.join(good, F.col("o_custkey") == F.col("c_custkey")))


@query(
    "check_structure",
    """SELECT c_custkey, coalesce(n_stages, 0) AS n_stages, coalesce(n_links, 0) AS n_links,
              CASE WHEN coalesce(n_stages, 0) > 0 OR coalesce(n_links, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS status
       FROM customer LEFT JOIN (SELECT o_custkey AS a, count(*) AS n_stages FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON a = c_custkey
       LEFT JOIN (SELECT o_custkey AS b, count(*) AS n_links FROM orders WHERE o_totalprice < 20000 GROUP BY 1) ON b = c_custkey""",
)
def check_structure(spark, d):
    orders = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return Q.check_structure(
        load(spark, d, "customer"), orders.where("o_totalprice > 450000"), orders.where("o_totalprice < 20000"), "c_custkey"
    )


@query(
    "check_reconcile",
    CHANGES_SQL + """SELECT (SELECT count(*) FROM src) AS n_left, (SELECT count(*) FROM tgt) AS n_right,
       (SELECT count(*) FROM (SELECT * FROM src EXCEPT ALL SELECT * FROM tgt)) AS only_left,
       (SELECT count(*) FROM (SELECT * FROM tgt EXCEPT ALL SELECT * FROM src)) AS only_right, 'FAIL' AS status""",
)
def check_reconcile(spark, d):
    src, tgt = source_and_target(spark, d)
    return Q.check_reconcile(src, tgt)
