"""Change capture, change apply, upserts and slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.joins import kept_rows, null_salt
from stageloom.operators.ordering import OrderKey, first_per_group, reversed_order

OPEN_END = "9999-12-31"


def _on_keys(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(
        lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    )


def _differs(columns: Sequence[str], a: str, b: str) -> Column:
    return reduce(
        lambda x, y: x | y,
        [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns],
        F.lit(False),
    )


def has_keys(keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])


def _full_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_tag: str, b_tag: str) -> DataFrame:
    """Full join of two tables as structs, one scan a side. Rows with a NULL key match nothing; a salt spreads them."""

    def salted(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(tag), null_salt(df, has_keys(keys)).alias(f"{tag}_salt"))

    on = _on_keys(keys, a_tag, b_tag) & (F.col(f"{a_tag}_salt") == F.col(f"{b_tag}_salt"))
    return salted(a, a_tag).join(salted(b, b_tag), on, "full").select(a_tag, b_tag)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey]) -> DataFrame:
    """The last row of each key in ``order``; rows with a NULL key all stay."""
    return latest_per_key(df.where(has_keys(keys)), keys, order).unionByName(df.where(~has_keys(keys)))


def one_per_key(source: DataFrame, keys: Sequence[str], order: Sequence[OrderKey] | None) -> DataFrame:
    """The last row of each key in ``order``, by default that of all other columns; rows with a NULL key stay.

    Without an order the key columns are looked at first, and a source without repeats comes back as it is: no sort.
    """
    if not order:
        counts = source.where(has_keys(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if counts.where(F.col("_n") > 1).isEmpty():
            return source
        order = [c for c in source.columns if c not in keys] or list(keys)
    return last_per_key(source, keys, order)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey]
) -> DataFrame:
    """One row per key, the last in the given order."""
    return first_per_group(df, keys, reversed_order(order))


def change_capture(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of both tables with ``change``: insert, update, unchanged or not_in_source.

    Values come from ``after``, or from ``before`` where the source has no such key.
    """
    compare = compare or [c for c in after.columns if c not in keys]
    joined = _full_join(before, after, keys, "b", "a")
    change = (
        F.when(F.col("b").isNull(), "insert")
        .when(F.col("a").isNull(), "not_in_source")
        .when(_differs(compare, "a", "b"), "update")
        .otherwise("unchanged")
    )
    return joined.select(
        *[
            F.when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
            for c in [*keys, *compare]
        ],
        change.alias("change"),
    )


def change_apply(
    target: DataFrame | None, source: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Target rows the source does not have, plus every source row."""
    if target is None:
        return source
    return kept_rows(source, target, keys).unionByName(source)


def with_cdc_meta(df: DataFrame, ts: Column, operation: str = "UPSERT") -> DataFrame:
    return df.withColumns({"_cdc_timestamp": ts, "_cdc_operation": F.lit(operation)})


def insert_select(
    target: DataFrame, source: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Append the source; with a column list the other target columns become NULL."""
    rows = source.select(*columns) if columns else source
    return target.unionByName(rows, allowMissingColumns=bool(columns))


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str] = ("id",),
    update_columns: Sequence[str] | None = None,
    order: Sequence[OrderKey] | None = None,
) -> DataFrame:
    """Matched rows take the listed columns from the source, unmatched source rows are added.

    Of several source rows with one key the last in ``order`` counts (see ``one_per_key``).
    """
    if update_columns is None:
        update_columns = [c for c in target.columns if c not in keys]
    joined = _full_join(target, one_per_key(source, keys, order), keys, "t", "s")
    new, kept = F.col("t").isNull(), F.col("s").isNull()
    out = []
    for c in target.columns:
        from_source = (
            F.col(f"s.{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
        )
        matched = from_source if c in update_columns and c in source.columns else F.col(f"t.{c}")
        out.append(
            F.when(new, from_source).when(kept, F.col(f"t.{c}")).otherwise(matched).alias(c)
        )
    return joined.select(*out)


def scd2_initial(source: DataFrame, as_of: Column) -> DataFrame:
    """First load of a dimension: every row is the open version."""
    return source.withColumns(
        {
            "effective_start_date": as_of.cast("date"),
            "effective_end_date": F.lit(OPEN_END).cast("date"),
            "is_current": F.lit(True),
        }
    )


def scd2(
    dim: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str],
    as_of: Column,
    order: Sequence[OrderKey] | None = None,
) -> DataFrame:
    """Type-2 update: close changed versions, open new ones, keep the rest.

    One full join against the open versions; each joined row gives one or two versions. Versions that
    are not current, or do not say so, pass by untouched. Of several source rows with one key
    the last in ``order`` counts (see ``one_per_key``).
    """
    columns = [*keys, *compare]
    validity = ["effective_start_date", "effective_end_date", "is_current"]
    dim = dim.select(*columns, *validity)
    current = F.coalesce(F.col("is_current"), F.lit(False))
    history = dim.where(~current)
    source = one_per_key(source, keys, order).select(*columns)
    joined = _full_join(dim.where(current), source, keys, "d", "s")
    day, end = as_of.cast("date"), F.lit(OPEN_END).cast("date")

    def version(side: str, start, stop, current: bool) -> Column:
        return F.struct(
            *[F.col(f"{side}.{c}").alias(c) for c in columns],
            start.alias(validity[0]),
            stop.alias(validity[1]),
            F.lit(current).alias(validity[2]),
        )

    opened = version("s", day, end, True)
    kept = version("d", F.col("d.effective_start_date"), F.col("d.effective_end_date"), True)
    closed = version("d", F.col("d.effective_start_date"), day, False)
    versions = (
        F.when(F.col("d").isNull(), F.array(opened))
        .when(F.col("s").isNull(), F.array(kept))
        .when(_differs(compare, "d", "s"), F.array(closed, opened))
        .otherwise(F.array(kept))
    )
    return joined.select(F.inline(versions)).unionByName(history)


def cdc_run(
    source: DataFrame,
    base: str,
    keys: Sequence[str],
    bookmark: str,
    order: Sequence[OrderKey],
) -> bool:
    """One incremental run: rows that were not read before become a delta of the target, folded when enough wait.

    Returns False, and writes nothing, if nothing is new. The bookmark moves after the target, so a
    run lost in between is repeated with the same result. Late rows at the bookmark's value and rows without a value
    are read once (see ``files.incremental_read``).
    """
    from stageloom.scratch import materialise
    from stageloom.sources import deltas
    from stageloom.sources.files import bookmark_rows, incremental_read
    from stageloom.sources.sinks import overwrite, read_current

    spark = source.sparkSession
    seen = read_current(spark, f"{base}/bookmark")
    last = None if seen is None else seen.agg(F.max(bookmark)).first()[0]
    fresh, top = incremental_read(source, bookmark, last, seen)
    fresh = materialise(fresh, "fresh")
    if fresh.isEmpty():
        return False
    deltas.upsert(latest_per_key(fresh, keys, order), f"{base}/target", keys)
    deltas.tidy(spark, f"{base}/target")
    overwrite(bookmark_rows(fresh, bookmark, top, seen), f"{base}/bookmark")
    return True
