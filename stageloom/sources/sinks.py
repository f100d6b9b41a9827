"""Writers and load rules."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.operators.ordering import group_number
from stageloom.operators.project import cast_declared
from stageloom.sources import commits, deltas

def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite"
) -> None:
    """Snappy parquet by partition keys.

    The rebalance hint gathers each partition value into few files and lets AQE split a
    value that holds most of the rows.
    """
    df.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).partitionBy(
        *keys
    ).option("compression", "snappy").parquet(path)


def write_format(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_table(df: DataFrame, name: str, mode: str = "append", bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    writer = df.write.mode(mode).format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by)
    writer.saveAsTable(name)


def write_set(df: DataFrame) -> DataFrame:
    """SET table: no duplicate rows."""
    return df.distinct()


def stage_raw(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Staging form: all text, all nullable; without columns one ``raw_data`` text per row."""
    if not columns:
        return df.select(F.to_json(F.struct(*df.columns)).alias("raw_data"))
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def load_declared(
    df: DataFrame, columns: Sequence[Mapping], primary_key: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Typed rows that satisfy the declaration, and rejects with a reason.

    A NULL takes the declared default; a NULL left in a NOT NULL column rejects the
    row, as does a key seen before (rows ordered by all columns).
    """
    typed = cast_declared(df, columns)
    defaults = {
        c["name"]: F.coalesce(F.col(c["name"]), F.lit(c["default"]).cast(typed.schema[c["name"]].dataType))
        for c in columns
        if c.get("default") is not None
    }
    if defaults:
        typed = typed.withColumns(defaults)
    required = [c["name"] for c in columns if not c.get("nullable", True) or c["name"] in primary_key]
    reason = F.lit(None).cast("string")
    for name in reversed(required):
        reason = F.when(F.col(name).isNull(), f"null {name}").otherwise(reason)
    marked = typed.withColumn("reason", reason)
    if primary_key:
        complete = marked.where(F.col("reason").isNull())
        numbered = group_number(complete, primary_key, typed.columns, "_rn").withColumn(
            "reason", F.when(F.col("_rn") > 1, "duplicate key")
        ).drop("_rn")
        marked = marked.where(F.col("reason").isNotNull()).unionByName(numbered)
    return (
        marked.where(F.col("reason").isNull()).drop("reason"),
        marked.where(F.col("reason").isNotNull()),
    )


def flatten_arrays(df: DataFrame, sep: str = "; ") -> DataFrame:
    """Array columns as joined text, for flat export."""
    return df.select(
        *[
            F.array_join(F.col(f.name).cast("array<string>"), sep).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def current_version(spark: SparkSession, base: str) -> int:
    """Number of the version a reader should see; -1 before the first write."""
    return commits.latest(spark, base)[0]


def overwrite(df: DataFrame, base: str, version: int | None = None) -> int:
    """Replace a table without touching the version being read; the new version's number.

    The rows go to a folder of their own, and the version is published once they are complete, so a lost job leaves the
    old version in place. A given ``version`` that is there already (a repeated batch) is left as it is. Raises
    ConcurrentCommit if another writer published the number meanwhile: what this one read is no longer current.
    """
    spark = df.sparkSession
    newest = commits.latest(spark, base)[0]
    if version is None:
        version = newest + 1
    elif version <= newest:
        return version
    folder = f"v={version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    if not commits.publish(spark, base, version, {"folder": folder}):
        commits.drop_folder(spark, base, folder)
        raise commits.ConcurrentCommit(f"version {version} of {base} was written by another job")
    commits.prune(spark, base)
    return version


def read_version(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table that is overwritten (below ``before``); None before the first."""
    state = commits.latest(spark, base, before)[1]
    return None if state is None else spark.read.parquet(f"{base}/{state['folder']}")


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    """The current rows of a table that is overwritten or takes upserts; None before the first write."""
    state = commits.latest(spark, base)[1]
    return deltas.read(spark, base) if state and "buckets" in state else read_version(spark, base)
