"""Batches, templates and representatives of grouped entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.aggregate import best_per_group
from stageloom.operators.ordering import OrderKey, group_number, parse_key
from stageloom.operators.windows import chunk_groups


def template_score() -> Column:
    """Structure known, steps, links, success probability, moderate complexity."""
    score = (
        F.when(
            F.col("n_stages").isNotNull(),
            F.lit(10.0) + F.col("n_stages") * F.lit(0.1) + F.col("n_links") * F.lit(0.05),
        ).otherwise(0.0)
        + F.coalesce("success_probability", F.lit(0.0)) * F.lit(5.0)
        + F.when(F.coalesce("score", F.lit(5.0)).between(3, 7), 2.0).otherwise(0.0)
    )
    return F.round(score, 6)


def select_template(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Best template of each group; the lowest key wins a tie."""
    scored = df.withColumn("template_score", template_score())
    return best_per_group(scored, group, "template_score", [key]).select(
        *group, F.col(key).alias("template"), "template_score"
    )


def batch_savings(n: Column) -> Column:
    """Share saved by one full call plus small variations."""
    saved = F.lit(1) - (F.lit(3500) + (n - 1) * 500) / (n * 3500)
    return F.round(saved, 2)


def build_batches(
    df: DataFrame,
    key: str,
    cluster: str,
    family: str,
    order: Sequence[OrderKey],
    max_size: int = 20,
    min_size: int = 2,
) -> DataFrame:
    """Batches by cluster first; what is left over goes by family (not ``other``)."""

    def cut(rows: DataFrame, by: str, prefix: str) -> DataFrame:
        chunks = chunk_groups(rows.select(key, by, *[c for c in _names(order) if c not in (key, by)]), [by], order, max_size, min_size)
        return chunks.select(
            key,
            F.concat(F.lit(prefix), F.col(by).cast("string"), F.lit("_"), F.col("chunk").cast("string")).alias("batch_id"),
            F.col("chunk_size").cast("long").alias("batch_size"),
        )

    in_cluster = df.where(F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "-"))
    first = cut(in_cluster, cluster, "batch_")
    rest = df.join(first.select(key), key, "left_anti").where(
        F.col(family).isNotNull() & (F.col(family) != "other")
    )
    return first.unionByName(cut(rest, family, "pattern_")).withColumn(
        "savings", batch_savings(F.col("batch_size"))
    )


def _names(order: Sequence[OrderKey]) -> list[str]:
    return [parse_key(k)[0] for k in order]


def select_representatives(
    df: DataFrame, cluster: str, key: str, target: int = 1000
) -> DataFrame:
    """First members of each cluster in proportion to its size: of ``target`` in all, but at least one of each.

    With many small clusters these are more than ``target`` rows; the caller may cut them.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    quota = sizes.withColumn(
        "_quota", F.greatest(F.lit(1), F.floor(F.col("_n") / total * target))
    )
    ranked = group_number(df.select(cluster, key), [cluster], [key], "_rn")
    return (
        ranked.join(quota, cluster)
        .where(F.col("_rn") <= F.col("_quota"))
        .select(cluster, key)
    )


def cluster_membership(
    entities: DataFrame,
    key: str,
    duplicates: DataFrame,
    clusters: DataFrame,
    families: DataFrame,
) -> DataFrame:
    """Duplicate group, similarity cluster and family of each entity.

    ``duplicates`` has ``group_id``, ``clusters`` has ``cluster_id``, ``families`` has ``family``. An entity
    in several clusters shows the last one in cluster order.
    """
    dup = duplicates.select(
        key, F.concat(F.lit("DUP_"), F.col("group_id").cast("string")).alias("duplicate_group")
    )
    sim = (
        clusters.groupBy(key)
        .agg(F.max_by("cluster_id", "cluster_rank").alias("c"))
        .select(key, F.concat(F.lit("SIM_"), F.col("c").cast("string")).alias("similarity_cluster"))
    )
    return (
        entities.select(key)
        .join(dup, key, "left")
        .join(sim, key, "left")
        .join(families.select(key, "family"), key, "left")
    )
