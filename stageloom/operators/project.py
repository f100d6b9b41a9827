"""Row-wise stages: mapping, filtering, routing, typing, keys and hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.functions.types import spark_type
from stageloom.operators.ordering import OrderKey, dense_number


def apply_mapping(
    df: DataFrame, mappings: Sequence[tuple[str, str, str, str]]
) -> DataFrame:
    """``(source, source type, target, target type)`` rows; unmapped columns are dropped."""
    return df.select(
        *[
            F.col(source).cast(source_type).cast(target_type).alias(target)
            for source, source_type, target, target_type in mappings
        ]
    )


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def copy_stage(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Pass through, narrow, or duplicate: a mapping gives ``{output name: input name}``."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(src).alias(out) for out, src in columns.items()])
    return df.select(*columns)


def modify(
    df: DataFrame, casts: Mapping[str, str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    if casts:
        df = df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
    return df.drop(*drop)


def column_generator(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def filter_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def switch_route(
    df: DataFrame,
    routes: Sequence[tuple[str, Column]],
    default: str = "default",
    out: str = "route",
) -> DataFrame:
    """Mark each row with the first output whose condition holds."""
    branch = None
    for name, condition in routes:
        branch = (F if branch is None else branch).when(condition, F.lit(name))
    return df.withColumn(
        out, branch.otherwise(F.lit(default)) if branch is not None else F.lit(default)
    )


def with_audit(df: DataFrame, table: str, from_files: bool = False) -> DataFrame:
    """Load time and origin of each row; the file path needs a file scan as input."""
    if from_files:
        df = df.withColumn("_source_file", F.col("_metadata.file_path"))
    return df.withColumns(
        {
            "_extracted_at": F.current_timestamp(),
            "_load_timestamp": F.current_timestamp(),
            "_source_table": F.lit(table),
        }
    )


def surrogate_key(
    df: DataFrame,
    out: str,
    order: Sequence[OrderKey] = (),
    mode: str = "dense",
    existing: DataFrame | None = None,
    existing_key: str | None = None,
) -> DataFrame:
    """Add a key column.

    ``unique``: unique but with gaps, no shuffle. ``dense``: 1..n by natural key.
    ``continue``: dense, starting after the highest key of ``existing``.
    """
    if mode == "unique":
        return df.withColumn(out, F.monotonically_increasing_id())
    if mode == "dense":
        return dense_number(df, order, out)
    if mode == "continue":
        top = existing.agg(F.max(existing_key)).first()[0] or 0
        return dense_number(df, order, out, start=int(top))
    raise ValueError(f"unknown mode {mode!r}")


def row_number_global(
    df: DataFrame, order: Sequence[OrderKey], out: str = "inrownum"
) -> DataFrame:
    return dense_number(df, order, out)


def cast_declared(df: DataFrame, columns: Sequence[Mapping]) -> DataFrame:
    """Type raw columns by declaration; text that does not convert becomes NULL."""
    out = []
    for spec in columns:
        name = spec["name"]
        target = spark_type(spec)
        column = F.col(name).try_cast(target)
        if target == "string" and spec.get("length"):
            column = F.left(column, F.lit(int(spec["length"])))
        out.append(column.alias(name))
    return df.select(*out)


def record_hash(
    df: DataFrame,
    exclude: Sequence[str] = (),
    out: str = "_record_hash",
    separator: str = "|",
) -> DataFrame:
    """sha256 over the text form of all columns but ``exclude`` and ``_``-metadata.

    NULL and the empty text hash alike.
    """
    parts = [
        F.coalesce(F.col(c).cast("string"), F.lit(""))
        for c in df.columns
        if c not in exclude and not c.startswith("_")
    ]
    return df.withColumn(out, F.sha2(F.concat_ws(separator, *parts), 256))


def filter_in(df: DataFrame, column: str, names: str | DataFrame) -> DataFrame:
    """Keep rows whose value is in a comma-separated list, or in a one-column table."""
    if isinstance(names, DataFrame):
        listed = names.select(F.col(names.columns[0]).alias(column)).distinct()
        return df.join(listed, column, "left_semi")
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    return df.where(F.col(column).isin(wanted))
