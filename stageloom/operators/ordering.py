"""Ordered computation that never needs a whole table, or a whole hot group, in one task.

Two tools:

* ``dense_number`` numbers a table 1..n in a given order. A range shuffle puts the
  rows into ordered blocks, the blocks are stored, and the number of a row is its place
  in the block plus the rows in earlier blocks.
* ``ordered_scan`` computes running values inside groups. Groups that fit one task use a
  plain window. Larger groups are cut into ordered blocks; each block is
  scanned on its own and gets what the earlier blocks of its group carry over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageloom.operators.sizing import literal_table
from stageloom.scratch import materialise

#: A group above this many rows is split into blocks of about this size.
ROWS_PER_TASK = 4_000_000

#: Up to this many hot groups, tables with a row per hot group or block are broadcast.
FEW_GROUPS = 100_000

#: Slots of a key's hash that rows are counted by when hot groups are sought.
SLOTS = 65_536

_BLOCK_SHIFT = 33  # monotonically_increasing_id() = (partition << 33) + row in partition

OrderKey = str | tuple[str, ...]
Scan = dict[str, tuple[str, str | None]]


def sort_columns(order: Sequence[OrderKey]) -> list[Column]:
    """``"c"``, ``("c", "desc")`` or ``("c", "desc", "first")``; NULLs come last unless said."""
    out = []
    for key in order:
        name, direction, nulls = parse_key(key)
        column = getattr(F.col(name), f"{direction}_nulls_{nulls}")
        out.append(column())
    return out


def parse_key(key: OrderKey) -> tuple[str, str, str]:
    parts = key if isinstance(key, tuple) else (key,)
    return (*parts, *("asc", "last")[len(parts) - 1 :])


def reversed_order(order: Sequence[OrderKey]) -> list[OrderKey]:
    """The exact reverse, NULL placement included."""
    flip = {"asc": "desc", "desc": "asc", "first": "last", "last": "first"}
    return [(n, flip[d], flip[nulls]) for n, d, nulls in map(parse_key, order)]


def ordered_blocks(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[OrderKey],
    partitions: int | None = None,
) -> DataFrame:
    """Store ``df`` in global (group, order) order, with ``_rid`` ascending in that order.

    Range partitioning uses the order columns as well as the group, so one huge group
    still spreads over many blocks.
    """
    keys = [F.col(c).asc_nulls_last() for c in group] + sort_columns(order)
    ranged = (
        df.repartitionByRange(partitions, *keys)
        if partitions
        else df.repartitionByRange(*keys)
    )
    numbered = ranged.sortWithinPartitions(*keys).withColumn(
        "_rid", F.monotonically_increasing_id()
    )
    return materialise(numbered, "blocks")


def _block() -> Column:
    return F.shiftright("_rid", _BLOCK_SHIFT).cast("int")


def dense_number(
    df: DataFrame,
    order: Sequence[OrderKey],
    out: str = "rn",
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows ``start + 1 .. start + n`` in the given (total) order."""
    spark = df.sparkSession
    stored = ordered_blocks(df, [], order, partitions)
    # One row per block, so this fits the driver whatever the table holds.
    counts = dict(stored.groupBy(_block().alias("b")).count().collect())
    offsets, total = [], start
    for block in sorted(counts):
        offsets.append((block, total))
        total += counts[block]
    offset = literal_table(spark, offsets, "_block int, _offset long")
    place = F.col("_rid").bitwiseAND(F.lit((1 << _BLOCK_SHIFT) - 1))
    return (
        stored.withColumn("_block", _block())
        .join(F.broadcast(offset), "_block")
        .withColumn(out, F.col("_offset") + place + 1)
        .drop("_block", "_offset", "_rid")
    )


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys]
    )


def hot_groups(df: DataFrame, group: Sequence[str], limit: int) -> DataFrame | None:
    """Groups with more than ``limit`` rows, or None. At most rows/limit of them exist.

    Only the key columns are read and the counts are combined map-side: rows are counted by slots of the key's hash, and
    keys only in slots with more than ``limit`` rows, so that a table without hot groups is not shuffled for them.
    """
    slot = F.pmod(F.xxhash64(*group), F.lit(SLOTS)).cast("int")
    heavy = df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_slot").collect()
    if not heavy:
        return None
    slots = literal_table(df.sparkSession, [tuple(r) for r in heavy], "_slot int")
    counts = (
        df.select(*group).withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi")
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
    )
    hot = materialise(counts, "hot")
    return None if hot.isEmpty() else hot


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[OrderKey],
    steps: Sequence[Scan | Callable[[DataFrame], DataFrame]],
    limit: int | None = None,
) -> DataFrame:
    """Running values per group, in order.

    ``steps`` alternates scans ``{out: (function, column)}`` with row-wise projections.
    Functions: ``row_number``, ``count``, ``sum``, ``min``, ``max`` (all up to and including the
    current row) and ``lag``. The order must be total for the result to be defined.
    """
    limit = limit or ROWS_PER_TASK
    hot = hot_groups(df, group, limit)
    if hot is None:
        return _scan_native(df, group, order, steps)
    n_hot, rows_hot = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    keys = hot.select(*group)
    few = n_hot <= FEW_GROUPS
    if few:
        keys = F.broadcast(keys)
    same = null_safe(df, keys, group)
    cold = _scan_native(df.join(keys, same, "left_anti"), group, order, steps)
    blocks = ordered_blocks(
        df.join(keys, same, "left_semi"), group, order, -(-rows_hot // limit)
    )
    return cold.unionByName(_scan_blocks(blocks, group, steps, few))


def _scan_native(df, group, order, steps):
    base = Window.partitionBy(*group).orderBy(*sort_columns(order))
    running = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for step in steps:
        if callable(step):
            df = step(df)
            continue
        columns = {}
        for out, (fn, arg) in step.items():
            if fn == "row_number":
                columns[out] = F.row_number().over(base).cast("long")
            elif fn == "lag":
                columns[out] = F.lag(arg).over(base)
            else:
                columns[out] = getattr(F, fn)(F.col(arg)).over(running)
        df = df.withColumns(columns)
    return df


def _scan_blocks(blocks, group, steps, few):
    """Scan (group, block) pieces in parallel, then add what earlier pieces carry.

    The carry has one row per piece, no more than blocks plus hot groups; it is broadcast
    only if there are few hot groups.
    """
    df = blocks.withColumn("_block", _block())
    piece = [*group, "_block"]
    base = Window.partitionBy(*piece).orderBy("_rid")
    running = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (
        Window.partitionBy(*group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    previous = Window.partitionBy(*group).orderBy("_block")
    for step in steps:
        if callable(step):
            df = step(df)
            continue
        local, per_piece, carry = {}, [], {}
        for out, (fn, arg) in step.items():
            total, c = f"_t_{out}", f"_c_{out}"
            if fn == "row_number":
                local[out] = F.row_number().over(base).cast("long")
                per_piece.append(F.count(F.lit(1)).alias(total))
                carry[c] = F.sum(total).over(before)
            elif fn == "lag":
                local[out] = F.lag(arg).over(base)
                per_piece.append(F.max_by(F.struct(arg), "_rid").alias(total))
                carry[c] = F.lag(F.col(total)[arg]).over(previous)
            else:
                local[out] = getattr(F, fn)(F.col(arg)).over(running)
                per_piece.append(getattr(F, fn)(arg).alias(total))
                merge = {"count": F.sum}.get(fn, getattr(F, fn))
                carry[c] = merge(F.col(total)).over(before)
        carried = (
            df.groupBy(*piece)
            .agg(*per_piece)
            .withColumns(carry)
            .select(*[F.col(k).alias(f"_k_{k}") for k in piece], *carry)
        )
        df = df.withColumns({**local, "_first": F.row_number().over(base) == 1})
        on = reduce(
            lambda a, b: a & b,
            [df[k].eqNullSafe(carried[f"_k_{k}"]) for k in piece],
        )
        df = df.join(F.broadcast(carried) if few else carried, on, "left")
        merged = {}
        for out, (fn, _) in step.items():
            value, c = F.col(out), F.col(f"_c_{out}")
            if fn in ("row_number", "count"):
                merged[out] = value + F.coalesce(c, F.lit(0))
            elif fn == "sum":
                both = value + c
                merged[out] = F.coalesce(both, value, c)
            elif fn == "lag":
                merged[out] = F.when(F.col("_first"), c).otherwise(value)
            else:
                pick = F.least if fn == "min" else F.greatest
                merged[out] = pick(value, c)
        df = df.withColumns(merged).drop(
            "_first", *[f"_k_{k}" for k in piece], *carry
        )
    return df.drop("_rid", "_block")


def group_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[OrderKey],
    out: str = "rn",
    limit: int | None = None,
) -> DataFrame:
    """Row number inside each group."""
    return ordered_scan(df, group, order, [{out: ("row_number", None)}], limit)


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], n: int = 1
) -> DataFrame:
    """The first ``n`` rows of each group.

    Catalyst turns ``row_number() <= n`` into a group limit that runs before the shuffle,
    so a hot key sends at most ``n`` rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
