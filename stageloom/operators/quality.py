"""Data quality checks: one aggregate, one scan per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.sizing import literal_table


def _verdict(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def check_not_empty(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("not_empty").alias("check_name"), _verdict(F.col("n_rows") > 0).alias("status"), "n_rows"
    )


def check_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key column, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    return counts.unpivot([], list(keys), "key_column", "n_nulls").withColumn(
        "status", _verdict(F.col("n_nulls") == 0)
    )


def missing_columns(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Expected columns that are absent or of another type."""
    have = dict(df.dtypes)
    return [f"{c} {t}" for c, t in expected.items() if have.get(c) != t]


def check_schema(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per expected column: expected and actual type, PASS or FAIL."""
    have = dict(df.dtypes)
    rows = [(c, t, have.get(c), "PASS" if have.get(c) == t else "FAIL") for c, t in expected.items()]
    return literal_table(df.sparkSession, rows, "column_name string, expected string, actual string, status string")


def check_row_preserving(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both counts in one job."""
    sides = before.select(F.lit(1).alias("b")).unionByName(
        after.select(F.lit(1).alias("a")), allowMissingColumns=True
    )
    return sides.agg(F.count("b").alias("n_before"), F.count("a").alias("n_after")).withColumn(
        "status", _verdict(F.col("n_before") == F.col("n_after"))
    )


def check_structure(jobs: DataFrame, stages: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Entities without any stage and without any link are invalid."""
    n_stages = stages.groupBy(key).agg(F.count(F.lit(1)).alias("n_stages"))
    n_links = links.groupBy(key).agg(F.count(F.lit(1)).alias("n_links"))
    return (
        jobs.select(key)
        .join(n_stages, key, "left")
        .join(n_links, key, "left")
        .na.fill(0, ["n_stages", "n_links"])
        .withColumn("status", _verdict((F.col("n_stages") > 0) | (F.col("n_links") > 0)))
    )


def check_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts and the rows (with multiplicity) that only one of two outputs has.

    Rows are compared as counted sets: one grouped pass over the union, so equal rows
    combine map-side and a row that occurs very often is no hot spot.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).cast("long").alias("_d")).unionByName(
        right.select(*columns, F.lit(-1).cast("long").alias("_d"))
    )
    per_row = both.groupBy(*columns).agg(
        F.sum("_d").alias("_diff"),
        F.count_if(F.col("_d") > 0).alias("_l"),
        F.count_if(F.col("_d") < 0).alias("_r"),
    )
    return per_row.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(F.greatest("_diff", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_diff"), F.lit(0))), F.lit(0)).alias("only_right"),
    ).withColumn("status", _verdict((F.col("only_left") == 0) & (F.col("only_right") == 0)))
