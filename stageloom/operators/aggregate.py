"""Grouping stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.ordering import OrderKey, first_per_group, group_number
from stageloom.operators.project import filter_all

MONEY = "decimal(18,2)"


def exact_sum(column: str | Column) -> Column:
    """Sum of money values without floating error, as double."""
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(value.cast(MONEY)).cast("double")


def exact_avg(column: str, digits: int = 6) -> Column:
    return F.round(exact_sum(column) / F.count(column), digits)


def aggregate(
    df: DataFrame,
    by: Sequence[str],
    aggs: Mapping[str, Column],
    pre_filters: Sequence[Column] = (),
    derive: Mapping[str, Column] | None = None,
    post: Sequence[Column] = (),
) -> DataFrame:
    """Filter, group, derive from the aggregates, filter the aggregates."""
    out = filter_all(df, pre_filters) if pre_filters else df
    out = out.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    if derive:
        out = out.withColumns(dict(derive))
    return filter_all(out, post) if post else out


def totals(df: DataFrame, aggs: Mapping[str, Column], since: Column | None = None) -> DataFrame:
    """One row of totals, over a look-back period if ``since`` is given."""
    if since is not None:
        df = df.where(since)
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def count_if_each(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        *[F.count_if(c).alias(n) for n, c in conditions.items()]
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(*[fn(F.col(c)).alias(f"n_{c}") for c in columns])


def label_counts(
    df: DataFrame, column: str, out: str = "label", clean: Callable[[Column], Column] | None = None
) -> DataFrame:
    """How often each value occurs over all arrays of the column.

    ``clean`` maps values to labels. It sees each distinct value once, however often it occurs.
    """
    n = F.count(F.lit(1)).alias("n")
    counts = df.select(F.explode(column).alias(out)).groupBy(out).agg(n)
    return counts if clean is None else counts.groupBy(clean(F.col(out)).alias(out)).agg(F.sum("n").alias("n"))


def most_common(df: DataFrame, column: str, k: int = 10, out: str = "label") -> DataFrame:
    return label_counts(df, column, out).orderBy(F.desc("n"), F.asc(out)).limit(k)


def pivot_stage(
    df: DataFrame, key: Sequence[str], column: str, values: Sequence, agg: Column
) -> DataFrame:
    """Listed values only, so no extra job looks for them."""
    return df.groupBy(*key).pivot(column, list(values)).agg(agg)


def bucket_counts(df: DataFrame, column: str, edges: Sequence[float], out: str = "bucket") -> DataFrame:
    """Rows per fixed-edge bucket: ``<e0``, ``e0-e1``, ..., ``>=en``."""
    value = F.col(column)
    label = F.when(value < edges[0], F.lit(f"<{edges[0]}"))
    for low, high in zip(edges, edges[1:]):
        label = label.when(value < high, F.lit(f"{low}-{high}"))
    label = label.when(value >= edges[-1], F.lit(f">={edges[-1]}"))
    return df.groupBy(label.alias(out)).agg(F.count(F.lit(1)).alias("n"))


def percent_of_total(df: DataFrame, by: Sequence[str], digits: int = 1) -> DataFrame:
    """Share of each group; the total is a scalar subquery, not a one-partition window."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, digits))


def group_members(df: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """Members of each group in sorted order, one row each, with the size of the group.

    The long form holds a group of any size; no row collects a whole group.
    """
    numbered = group_number(df.select(*key, member), key, [member], "member_no")
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_members"))
    return numbered.join(sizes, list(key))


def cluster_stats(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("n").alias("n_rows"),
        F.round(F.avg("n"), 4).alias("avg_size"),
        F.max("n").alias("max_size"),
        F.min("n").alias("min_size"),
        F.count_if(F.col("n") == 1).alias("n_singletons"),
    )


def best_per_group(
    df: DataFrame, key: Sequence[str], score: str, tie: Sequence[OrderKey]
) -> DataFrame:
    return first_per_group(df, key, [(score, "desc"), *tie])
