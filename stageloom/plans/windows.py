"""Window, sort, limit, sample and set stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.operators import sets as S
from stageloom.operators import windows as W
from stageloom.plans.registry import query
from stageloom.scratch import materialise
from stageloom.tables import load

SPEND_SQL = """SELECT c_nationkey, c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS spend,
  count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def spend(spark, d):
    joined = load(spark, d, "orders").join(
        load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend"), F.count(F.lit(1)).alias("n")
    )


@query(
    "window_rank",
    f"""SELECT c_nationkey, c_mktsegment, rank() OVER w AS rnk, dense_rank() OVER w AS drnk,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn
        FROM ({SPEND_SQL}) WINDOW w AS (PARTITION BY c_nationkey ORDER BY n DESC)""",
)
def window_rank(spark, d):
    by_n = [("n", "desc")]
    return W.window_columns(
        spend(spark, d),
        [
            W.WindowSpec("rnk", "rank", None, ["c_nationkey"], by_n),
            W.WindowSpec("drnk", "dense_rank", None, ["c_nationkey"], by_n),
            W.WindowSpec("rn", "row_number", None, ["c_nationkey"], [*by_n, "c_mktsegment"]),
        ],
    ).select("c_nationkey", "c_mktsegment", "rnk", "drnk", "rn")


@query(
    "window_running_sum",
    """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)
         AS DOUBLE) AS spent FROM orders""",
)
def window_running_sum(spark, d):
    rows = load(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    return W.window_columns(
        rows, [W.WindowSpec("spent", "sum", "price", ["o_custkey"], ["o_orderdate"])]
    ).select("o_orderkey", F.col("spent").cast("double").alias("spent"))


@query(
    "window_share",
    f"""SELECT c_nationkey, c_mktsegment, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY c_nationkey), 2) AS pct,
               CAST(max(n) OVER () AS BIGINT) AS top FROM ({SPEND_SQL})""",
)
def window_share(spark, d):
    out = W.window_columns(
        spend(spark, d).drop("spend"),
        [W.WindowSpec("total", "sum", "n", ["c_nationkey"]), W.WindowSpec("top", "max", "n")],
    )
    return out.select(
        "c_nationkey", "c_mktsegment", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("pct"), "top"
    )


LINE_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
LINE_KEYS = LINE_ORDER.split(", ")


@query(
    "dedup_row_number",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY {LINE_ORDER.replace('l_shipdate', 'l_shipdate DESC')}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_row_number(spark, d):
    return W.dedup_keep(
        load(spark, d, "lineitem"), ["l_orderkey"], [("l_shipdate", "desc"), *LINE_KEYS[1:]]
    ).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "waves",
    """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 50 + 1 AS BIGINT) AS wave
       FROM orders""",
)
def waves(spark, d):
    return W.waves(
        load(spark, d, "orders").select("o_orderkey", "o_totalprice"),
        [("o_totalprice", "desc"), "o_orderkey"],
    ).select("o_orderkey", "wave")


@query(
    "chunk_groups",
    """SELECT user_id, event_id, chunk, CAST(chunk_size AS BIGINT) AS chunk_size FROM (SELECT *, least(count(*) OVER (PARTITION BY user_id) - chunk * 20, 20) AS chunk_size
       FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS chunk
             FROM events)) WHERE chunk_size >= 2""",
)
def chunk_groups(spark, d):
    return W.chunk_groups(
        load(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]
    ).drop("ts")


@query(
    "budget_batches",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 30 + 1 AS BIGINT) AS batch FROM documents",
)
def budget_batches(spark, d):
    return W.budget_batches(load(spark, d, "documents").select("doc_id"), ["doc_id"])


@query(
    "representatives",
    "SELECT md5(text) AS fp, min(doc_id) AS representative, count(*) AS n_members FROM documents GROUP BY 1",
)
def representatives(spark, d):
    docs = load(spark, d, "documents").select(F.md5("text").alias("fp"), "doc_id")
    return W.representatives(docs, ["fp"], "doc_id")


@query(
    "collapse_runs",
    """SELECT user_id, run, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
       FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
       WHERE prev IS NULL OR prev <> event_type)""",
)
def collapse_runs(spark, d):
    return W.collapse_runs(
        load(spark, d, "events").select("user_id", "ts", "event_id", "event_type"),
        ["user_id"], ["ts", "event_id"], "event_type",
    )


@query(
    "normalise_by_max",
    "SELECT c_custkey, round(1 - c_acctbal / (SELECT max(c_acctbal) FROM customer), 6) AS inverse FROM customer",
)
def normalise_by_max(spark, d):
    return W.normalise_by_max(load(spark, d, "customer"), "c_acctbal", "inverse").select(
        "c_custkey", F.round("inverse", 6).alias("inverse")
    )


@query(
    "budget_alerts",
    """SELECT event_id, user_id, CAST(t AS DOUBLE) AS running_total,
              CASE WHEN t >= 5000 THEN 'over' WHEN t >= 4000 THEN 'near' ELSE 'ok' END AS alert
       FROM (SELECT event_id, user_id, sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS UNBOUNDED PRECEDING) AS t FROM events)""",
)
def budget_alerts(spark, d):
    return W.budget_alerts(
        load(spark, d, "events").select("event_id", "user_id", "ts", "value"),
        ["user_id"], ["ts", "event_id"], "value", 5000,
    ).select("event_id", "user_id", "running_total", "alert")


@query("sort_stage", "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def sort_stage(spark, d):
    return S.sort_stage(
        load(spark, d, "supplier").select("s_nationkey", "s_acctbal", "s_suppkey"),
        ["s_nationkey", ("s_acctbal", "desc"), "s_suppkey"],
    )


@query("head_stage", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def head_stage(spark, d):
    return S.head_stage(load(spark, d, "events").select("event_id", "ts"), 100, ["ts", "event_id"])


@query("tail_stage", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_stage(spark, d):
    return S.tail_stage(load(spark, d, "events").select("event_id", "ts"), 100, ["ts", "event_id"])


@query(
    "sample_hash",
    """SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8))::BIGINT % 100 < 10""",
)
def sample_hash(spark, d):
    return S.sample_hash(load(spark, d, "orders"), "o_orderkey", 10).select("o_orderkey", "o_custkey")


@query(
    "sample",
    "SELECT 0::BIGINT AS n_foreign, true AS share_in_range, count(*) AS n_rows FROM orders",
)
def sample(spark, d):
    """The sample holds rows of the table only, and a tenth of them give or take five standard deviations."""
    orders = load(spark, d, "orders")
    drawn = S.sample_stage(orders, 0.1, 42)
    foreign = drawn.exceptAll(orders).agg(F.count(F.lit(1))).scalar()
    n = orders.agg(F.count(F.lit(1)).alias("n_rows"))
    near = F.abs(drawn.agg(F.count(F.lit(1))).scalar() - F.col("n_rows") * 0.1) <= 5 * F.sqrt(F.col("n_rows") * 0.09)
    return n.select(foreign.alias("n_foreign"), near.alias("share_in_range"), "n_rows")


@query("peek_stage", "SELECT least(10, count(*)) AS n_rows, 0::BIGINT AS n_foreign FROM lineitem")
def peek_stage(spark, d):
    """Ten rows, all of the table."""
    lines = load(spark, d, "lineitem")
    seen = materialise(S.peek_stage(lines, 10), "peek")
    foreign = seen.exceptAll(lines).agg(F.count(F.lit(1))).scalar()
    return seen.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_foreign", foreign)


_BY = "(PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "window_offsets",
    f"""SELECT event_id, lag(event_id, 2, -1) OVER {_BY}) AS two_back, lead(event_type, 3) OVER {_BY}) AS three_on,
          first_value(event_type) OVER {_BY}) AS first_type, last_value(event_id) OVER {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id,
          nth_value(event_id, 3) OVER {_BY}) AS third_id FROM events""",
)
def window_offsets(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    by = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    specs = [
        W.WindowSpec("two_back", "lag", "event_id", offset=2, default=-1, **by),
        W.WindowSpec("three_on", "lead", "event_type", offset=3, **by),
        W.WindowSpec("first_type", "first_value", "event_type", **by),
        W.WindowSpec("last_id", "last_value", "event_id", frame=(None, None), **by),
        W.WindowSpec("third_id", "nth_value", "event_id", offset=3, **by),
    ]
    return W.window_columns(events, specs).drop("user_id", "ts", "event_type")


@query(
    "window_frames",
    f"""SELECT event_id, sum(event_id) OVER {_BY} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS near_sum,
          min(event_id) OVER {_BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before_min,
          max(event_id) OVER {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
          round(stddev(event_id) OVER {_BY}), 4) AS spread FROM events""",
)
def window_frames(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts")
    by = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    specs = [
        W.WindowSpec("near_sum", "sum", "event_id", frame=(-2, 1), **by),
        W.WindowSpec("before_min", "min", "event_id", frame=(-3, -1), **by),
        W.WindowSpec("so_far", "max", "event_id", frame=(None, 0), **by),
        W.WindowSpec("spread", "stddev", "event_id", **by),
    ]
    return W.window_columns(events, specs).withColumn("spread", F.round("spread", 4)).drop("user_id", "ts")


_RANGE = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN"


@query(
    "window_range",
    f"""SELECT event_id, count(*) {_RANGE} INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent,
          sum(event_id) {_RANGE} INTERVAL 90 MINUTE PRECEDING AND INTERVAL 90 MINUTE FOLLOWING)::BIGINT AS around,
          min(event_id) {_RANGE} INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING) AS day_min,
          max(event_id) {_RANGE} INTERVAL 2 HOUR FOLLOWING AND INTERVAL 1 DAY FOLLOWING) AS later_max FROM events""",
)
def window_range(spark, d):
    """Frames by time: rows of a user within so many seconds of the row."""
    hour = 3600
    by = {"partition_by": ["user_id"], "order_by": ["ts"]}
    specs = [
        W.WindowSpec("recent", "count", interval=(-6 * hour, 0), **by),
        W.WindowSpec("around", "sum", "event_id", interval=(-1.5 * hour, 1.5 * hour), **by),
        W.WindowSpec("day_min", "min", "event_id", interval=(-24 * hour, 24 * hour), **by),
        W.WindowSpec("later_max", "max", "event_id", interval=(2 * hour, 24 * hour), **by),
    ]
    return W.window_columns(load(spark, d, "events").select("event_id", "user_id", "ts"), specs).drop("user_id", "ts")


@query(
    "top_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def top_n(spark, d):
    return S.top_n(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query(
    "funnel",
    """SELECT c_custkey AS party, c_name AS name, c_mktsegment AS segment, NULL::INTEGER AS region FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier
       UNION ALL SELECT n_nationkey, n_name, NULL, n_regionkey FROM nation""",
)
def funnel(spark, d):
    c = load(spark, d, "customer").selectExpr("c_custkey AS party", "c_name AS name", "c_mktsegment AS segment")
    s = load(spark, d, "supplier").selectExpr("s_name AS name", "s_suppkey AS party")
    n = load(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS party", "n_name AS name", "n_regionkey AS region")
    return S.funnel(c, s, n)


@query(
    "union_all",
    "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier",
)
def union_all(spark, d):
    return S.funnel(
        load(spark, d, "customer").selectExpr("c_nationkey AS nation"),
        load(spark, d, "supplier").selectExpr("s_nationkey AS nation"),
    )


@query("remove_duplicates", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def remove_duplicates(spark, d):
    return S.remove_duplicates(load(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "remove_duplicates_keyed",
    "SELECT md5(text) AS fp, min(doc_id) AS doc_id FROM documents GROUP BY text",
)
def remove_duplicates_keyed(spark, d):
    docs = load(spark, d, "documents").select(F.md5("text").alias("fp"), "doc_id")
    return S.remove_duplicates(docs, ["fp"], ["doc_id"])


@query(
    "set_diff",
    """SELECT coalesce(a.k, b.k) AS member, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed'
              ELSE 'common' END AS status
       FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') a
       FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k""",
)
def set_diff(spark, d):
    lines = load(spark, d, "lineitem")
    a = lines.where("l_returnflag = 'A'").select("l_partkey")
    b = lines.where("l_returnflag = 'R'").select("l_partkey")
    return S.set_diff(a, b)
