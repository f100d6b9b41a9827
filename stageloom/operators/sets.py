"""Sort, limit, sample, union and de-duplication stages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.operators.ordering import OrderKey, first_per_group, reversed_order, sort_columns


def sort_stage(df: DataFrame, order: Sequence[OrderKey]) -> DataFrame:
    return df.orderBy(*sort_columns(order))


def head_stage(df: DataFrame, n: int, order: Sequence[OrderKey]) -> DataFrame:
    return sort_stage(df, order).limit(n)


def tail_stage(df: DataFrame, n: int, order: Sequence[OrderKey]) -> DataFrame:
    """Last ``n`` rows: the first ``n`` of the reversed order."""
    return head_stage(df, n, reversed_order(order))


def sample_stage(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df.sample(False, fraction, seed)


def sample_hash(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Repeatable sample: the same keys are taken on every run and in every table."""
    bucket = F.conv(F.left(F.md5(F.col(key).cast("string")), F.lit(8)), 16, 10).cast("bigint") % 100
    return df.where(bucket < percent)


def peek_stage(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def top_n(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return head_stage(df, n, [(column, "desc"), tie])


def funnel(*inputs: DataFrame) -> DataFrame:
    """Union by name; a column an input lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def remove_duplicates(
    df: DataFrame, keys: Sequence[str] = (), order: Sequence[OrderKey] = ()
) -> DataFrame:
    """Distinct rows, or with keys the first row per key in the given order."""
    return first_per_group(df, keys, order) if keys else df.distinct()


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two one-column tables as added (only in b), removed (only in a) or common."""
    left = a.select(F.col(a.columns[0]).alias("_a")).distinct()
    right = b.select(F.col(b.columns[0]).alias("_b")).distinct()
    return left.join(right, F.col("_a") == F.col("_b"), "full").select(
        F.coalesce("_a", "_b").alias("member"),
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .otherwise("common")
        .alias("status"),
    )
