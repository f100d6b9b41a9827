"""Grouping, pivot, bucket and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.operators import aggregate as A
from stageloom.operators.joins import LookupSpec, lookup
from stageloom.plans.registry import query
from stageloom.tables import load

REVENUE = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
REVENUE_SQL = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)"


def money(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    "aggregate_basic",
    f"""SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS order_year, count(*) AS n_lines,
               {REVENUE_SQL} AS revenue, max(l_quantity) AS max_qty,
               round({money('l_quantity')} / count(*), 6) AS avg_qty
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
)
def aggregate_basic(spark, d):
    """Flagship: revenue by nation of the buyer and year of the order."""
    lines = load(spark, d, "lineitem").where("l_returnflag <> 'R'")
    joined = lines.join(
        load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spec = LookupSpec("nation", load(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name"])
    rows = lookup(joined, spec).withColumns(
        {"nation": F.col("nation_n_name"), "order_year": F.year("o_orderdate")}
    )
    return A.aggregate(
        rows,
        ["nation", "order_year"],
        {
            "n_lines": F.count(F.lit(1)),
            "revenue": F.sum(F.expr(REVENUE)).cast("double"),
            "max_qty": F.max("l_quantity"),
            "avg_qty": A.exact_avg("l_quantity"),
        },
    )


@query(
    "aggregate_prefilter",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {money('l_extendedprice')} AS total FROM lineitem
        WHERE l_shipdate < TIMESTAMP '2000-01-01' AND l_quantity < 25 GROUP BY 1, 2""",
)
def aggregate_prefilter(spark, d):
    return A.aggregate(
        load(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"n": F.count(F.lit(1)), "total": A.exact_sum("l_extendedprice")},
        pre_filters=[
            F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"),
            F.col("l_quantity") < 25,
        ],
    )


@query(
    "aggregate_having",
    f"""SELECT o_custkey, count(*) AS n, {money('o_totalprice')} AS total,
               round({money('o_totalprice')} / count(*), 6) AS mean_price
        FROM orders GROUP BY 1 HAVING count(*) >= 12""",
)
def aggregate_having(spark, d):
    return A.aggregate(
        load(spark, d, "orders"),
        ["o_custkey"],
        {"n": F.count(F.lit(1)), "total": A.exact_sum("o_totalprice")},
        derive={"mean_price": F.round(F.col("total") / F.col("n"), 6)},
        post=[F.col("n") >= 12],
    )


@query(
    "totals_lookback",
    f"""SELECT count(*) AS requests, {money('value')} AS cost, round({money('value')} / count(value), 6) AS mean_cost
        FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""",
)
def totals_lookback(spark, d):
    cutoff = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 7 DAY")
    return A.totals(
        load(spark, d, "events"),
        {"requests": F.count(F.lit(1)), "cost": A.exact_sum("value"), "mean_cost": A.exact_avg("value")},
        since=F.col("ts") > cutoff,
    )


@query(
    "conditional_counts",
    """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors,
              count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 100) AS dear
       FROM events GROUP BY 1""",
)
def conditional_counts(spark, d):
    return A.count_if_each(
        load(spark, d, "events"),
        {
            "errors": F.col("event_type") == "error",
            "purchases": F.col("event_type") == "purchase",
            "dear": F.col("value") > 100,
        },
        ["user_id"],
    )


@query(
    "distinct_counts",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey
       FROM lineitem GROUP BY 1""",
)
def distinct_counts(spark, d):
    return A.distinct_counts(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag"])


@query(
    "most_common",
    """SELECT word AS label, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
       GROUP BY 1 ORDER BY n DESC, label LIMIT 10""",
)
def most_common(spark, d):
    return A.most_common(load(spark, d, "part").select(F.split("p_name", " ").alias("words")), "words", 10)


@query(
    "label_counts",
    """SELECT word AS label, count(*) AS n FROM
       (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')) AS word FROM documents) GROUP BY 1""",
)
def label_counts(spark, d):
    """Words are cut at blanks, which the cleaning keeps, so that it can follow the counting."""
    words = load(spark, d, "documents").select(F.split("text", " ").alias("words"))
    return A.label_counts(words, "words", clean=lambda word: F.regexp_replace(word, "[^A-Za-z]+", ""))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "pivot_stage",
    "SELECT o_custkey, "
    + ", ".join(
        f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '{p}') AS DOUBLE) AS \"{p}\""
        for p in PRIORITIES
    )
    + " FROM orders GROUP BY 1",
)
def pivot_stage(spark, d):
    return A.pivot_stage(
        load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", PRIORITIES, A.exact_sum("o_totalprice")
    )


@query(
    "bucket_counts",
    """SELECT CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 20 THEN '10-20' WHEN l_quantity < 40 THEN '20-40'
              ELSE '>=40' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1""",
)
def bucket_counts(spark, d):
    return A.bucket_counts(load(spark, d, "lineitem"), "l_quantity", [10, 20, 40])


@query(
    "percent_of_total",
    """SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 1) AS pct
       FROM events GROUP BY 1""",
)
def percent_of_total(spark, d):
    return A.percent_of_total(load(spark, d, "events"), ["event_type"])


@query(
    "group_members",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS member_no,
              count(*) OVER (PARTITION BY o_custkey) AS n_members FROM orders""",
)
def group_members(spark, d):
    return A.group_members(load(spark, d, "orders"), ["o_custkey"], "o_orderkey")


@query(
    "cluster_stats",
    """SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n), 4) AS avg_size, max(n) AS max_size,
              min(n) AS min_size, count(*) FILTER (n = 1) AS n_singletons
       FROM (SELECT md5(text) AS fp, count(*) AS n FROM documents GROUP BY 1)""",
)
def cluster_stats(spark, d):
    return A.cluster_stats(load(spark, d, "documents").select(F.md5("text").alias("fp")), "fp")


@query(
    "best_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
         ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def best_per_group(spark, d):
    return A.best_per_group(
        load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_custkey"],
        "o_totalprice",
        ["o_orderkey"],
    )


@query(
    "flatten_counts",
    """SELECT label, count(*) AS n, round(avg(len(embedding)), 1) AS dims FROM embeddings GROUP BY 1""",
)
def flatten_counts(spark, d):
    return A.aggregate(
        load(spark, d, "embeddings"),
        ["label"],
        {"n": F.count(F.lit(1)), "dims": F.round(F.avg(F.size("embedding")), 1)},
    )
