"""Joins and lookups over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.operators import joins as J
from stageloom.operators.project import record_hash
from stageloom.plans.registry import query
from stageloom.tables import load


@query(
    "join_inner",
    """SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_totalprice > 100000""",
)
def join_inner(spark, d):
    orders = load(spark, d, "orders").where("o_totalprice > 100000")
    return J.join_stage(
        orders, load(spark, d, "customer"), ["o_custkey"], ["c_custkey"]
    ).select("o_orderkey", "c_name", "o_orderpriority")


@query(
    "join_left",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN
       (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey""",
)
def join_left(spark, d):
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return J.join_stage(
        load(spark, d, "customer"), urgent, ["c_custkey"], ["o_custkey"], "left"
    ).select("c_custkey", "o_orderkey")


@query(
    "join_right",
    """SELECT p_partkey, l_orderkey, l_linenumber, l_quantity FROM
       (SELECT * FROM lineitem WHERE l_quantity > 48) l RIGHT JOIN part ON l_partkey = p_partkey""",
)
def join_right(spark, d):
    big = load(spark, d, "lineitem").where("l_quantity > 48")
    return J.join_stage(big, load(spark, d, "part"), ["l_partkey"], ["p_partkey"], "right").select(
        "p_partkey", "l_orderkey", "l_linenumber", "l_quantity"
    )


@query(
    "join_full",
    """SELECT c.nk AS nation_c, s.nk AS nation_s, n_c, n_s FROM
       (SELECT c_nationkey AS nk, count(*) AS n_c FROM customer WHERE c_acctbal < 0 GROUP BY 1) c
       FULL JOIN (SELECT s_nationkey AS nk, count(*) AS n_s FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s
       ON c.nk = s.nk""",
)
def join_full(spark, d):
    c = load(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation_c")).agg(F.count("*").alias("n_c"))
    s = load(spark, d, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("nation_s")).agg(F.count("*").alias("n_s"))
    return J.join_stage(c, s, ["nation_c"], ["nation_s"], "full")


@query(
    "lookup_broadcast",
    """SELECT c_custkey, n_name AS nation_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup_broadcast(spark, d):
    spec = J.LookupSpec("nation", load(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name"])
    return J.lookup(load(spark, d, "customer"), spec).select("c_custkey", "nation_n_name")


@query(
    "lookup_defaults",
    """SELECT s_suppkey, coalesce(n_name, 'ELSEWHERE') AS nation_n_name, coalesce(n_regionkey, -1) AS nation_n_regionkey
       FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""",
)
def lookup_defaults(spark, d):
    spec = J.LookupSpec(
        "nation",
        load(spark, d, "nation").where("n_regionkey < 3"),
        "s_nationkey",
        "n_nationkey",
        ["n_name", "n_regionkey"],
        defaults={"n_name": "ELSEWHERE", "n_regionkey": -1},
    )
    return J.lookup(load(spark, d, "supplier"), spec).select(
        "s_suppkey", "nation_n_name", "nation_n_regionkey"
    )


@query(
    "lookup_chain",
    """SELECT o_orderkey, c_mktsegment AS buyer_c_mktsegment, n_name AS nation_n_name, r_name AS region_r_name
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_chain(spark, d):
    specs = [
        J.LookupSpec("buyer", load(spark, d, "customer"), "o_custkey", "c_custkey", ["c_mktsegment", "c_nationkey"]),
        J.LookupSpec("nation", load(spark, d, "nation"), "buyer_c_nationkey", "n_nationkey", ["n_name", "n_regionkey"]),
        J.LookupSpec("region", load(spark, d, "region"), "nation_n_regionkey", "r_regionkey", ["r_name"]),
    ]
    return J.lookup_chain(load(spark, d, "orders"), specs).select(
        "o_orderkey", "buyer_c_mktsegment", "nation_n_name", "region_r_name"
    )


def source_and_target(spark, d):
    """A change set against ``customer``: a part of it with new balances, plus new keys."""
    target = load(spark, d, "customer")
    bumped = F.when(F.expr("pmod(c_custkey, 5) = 0"), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    same_keys = target.where("c_acctbal >= 1000").withColumn("c_acctbal", bumped)
    new_keys = target.where("c_acctbal < 0").withColumn("c_custkey", F.col("c_custkey") + 100000000)
    return same_keys.unionByName(new_keys), target


CHANGES_SQL = """WITH tgt AS (SELECT * FROM customer), src AS (
  SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
         c_mktsegment FROM customer WHERE c_acctbal >= 1000
  UNION ALL SELECT c_custkey + 100000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0)
"""


@query("anti_join_new", CHANGES_SQL + "SELECT c_custkey, c_name FROM src WHERE c_custkey NOT IN (SELECT c_custkey FROM tgt)")
def anti_join_new(spark, d):
    src, tgt = source_and_target(spark, d)
    return J.new_rows(src, tgt, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "changed_rows",
    CHANGES_SQL + """SELECT src.c_custkey, src.c_acctbal FROM src JOIN tgt ON src.c_custkey = tgt.c_custkey
                     AND src.c_acctbal <> tgt.c_acctbal""",
)
def changed_rows(spark, d):
    src, tgt = source_and_target(spark, d)
    return J.changed_rows(
        record_hash(src, ["c_custkey"]), record_hash(tgt, ["c_custkey"]), ["c_custkey"], "_record_hash"
    ).select("c_custkey", "c_acctbal")


@query("anti_join_kept", CHANGES_SQL + "SELECT c_custkey, c_name FROM tgt WHERE c_custkey NOT IN (SELECT c_custkey FROM src)")
def anti_join_kept(spark, d):
    src, tgt = source_and_target(spark, d)
    return J.kept_rows(src, tgt, ["c_custkey"]).select("c_custkey", "c_name")


@query(
    "merge_stage",
    """SELECT c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, n_orders FROM customer LEFT JOIN
       (SELECT o_custkey, CASE WHEN count(*) > 12 THEN 'FREQUENT' END AS seg, count(*) AS n_orders FROM orders GROUP BY 1)
       ON c_custkey = o_custkey""",
)
def merge_stage(spark, d):
    updates = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.count("*") > 12, "FREQUENT").alias("c_mktsegment"), F.count("*").alias("n_orders")
    )
    master = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return J.merge_stage(master, updates, ["c_custkey"])


@query(
    "star_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_brand, s_name, n_name FROM lineitem
       JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def star_join(spark, d):
    return J.star_join(
        load(spark, d, "lineitem"),
        lookups=[(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))],
        sources=[
            (load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")),
            (load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")),
        ],
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_brand", "s_name", "n_name")


@query(
    "pair_enumeration",
    """SELECT DISTINCT p_brand, p_type, left_id, p_partkey AS right_id FROM part JOIN
       (SELECT p_brand AS b, p_type AS t, min(p_partkey) AS left_id FROM part GROUP BY 1, 2)
       ON b = p_brand AND t = p_type WHERE left_id < p_partkey""",
)
def pair_enumeration(spark, d):
    return J.group_links(load(spark, d, "part"), ["p_brand", "p_type"], "p_partkey")


@query(
    "pairs_incremental",
    """WITH pairs AS (SELECT DISTINCT p_brand, left_id, p_partkey AS right_id FROM part JOIN
         (SELECT p_brand AS b, min(p_partkey) AS left_id FROM part GROUP BY 1) ON b = p_brand WHERE left_id < p_partkey),
       done AS (SELECT DISTINCT left_id, p_partkey AS right_id FROM part JOIN
         (SELECT p_brand AS b, p_type AS t, min(p_partkey) AS left_id FROM part GROUP BY 1, 2)
         ON b = p_brand AND t = p_type WHERE left_id < p_partkey)
       SELECT p_brand, left_id, right_id FROM pairs WHERE (left_id, right_id) NOT IN (SELECT (left_id, right_id) FROM done)""",
)
def pairs_incremental(spark, d):
    part = load(spark, d, "part")
    pairs = J.group_links(part, ["p_brand"], "p_partkey")
    seen = J.group_links(part, ["p_brand", "p_type"], "p_partkey")
    # Results stored the other way round count as well.
    done = seen.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    return J.uncompared_pairs(pairs, done).select("p_brand", "left_id", "right_id")
