"""Window stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.operators import ordering
from stageloom.operators.ordering import (
    OrderKey,
    dense_number,
    first_per_group,
    group_number,
    hot_groups,
    ordered_scan,
    parse_key,
    reversed_order,
    sort_columns,
)
from stageloom.scratch import materialise


@dataclass
class WindowSpec:
    """One output column: ``function`` over ``column`` by ``partition_by`` and ``order_by``.

    ``offset`` and ``default`` belong to lag and lead, ``offset`` also to nth_value. ``frame`` is a ROWS frame
    (first, last) relative to the current row, None for unbounded; it needs a total order. ``interval`` is a RANGE frame
    (low, high) added to the value of the only order column, an ascending number or timestamp (then in seconds).
    """

    out: str
    function: str
    column: str | int | None = None
    partition_by: Sequence[str] = ()
    order_by: Sequence[OrderKey] = ()
    offset: int = 1
    default: object = None
    frame: tuple[int | None, int | None] | None = None
    interval: tuple[float, float] | None = None


RANKS = ("row_number", "rank", "dense_rank")
SHARES = ("percent_rank", "cume_dist", "ntile")
RUNNING = ("sum", "count", "min", "max", "avg", "stddev")
VALUES = ("first_value", "last_value", "nth_value")


def window_columns(
    df: DataFrame, specs: Sequence[WindowSpec], limit: int | None = None
) -> DataFrame:
    """Add window columns to a (usually aggregated) table.

    Without an order the value of a group is a grouped aggregate joined back. With an
    order, peers share one value as in the default SQL frame.
    """
    for spec in specs:
        if not spec.order_by:
            df = _whole_group(df, spec)
        elif spec.function in RANKS:
            df = _rank(df, spec, limit)
        elif spec.function in SHARES:
            df = _share(df, spec, limit)
        elif spec.function in ("lag", "lead"):
            df = _offset(df, spec, limit)
        elif spec.function in VALUES:
            df = _value_at(df, spec, limit)
        elif spec.function in RUNNING and spec.interval is not None:
            df = _interval(df, spec, limit)
        elif spec.function in RUNNING and spec.frame is None:
            df = _running(df, spec, limit)
        elif spec.function in RUNNING:
            df = _framed(df, spec, limit)
        else:
            raise ValueError(f"unknown window function {spec.function!r}")
    return df


def _share(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    """Functions of a rank and the size of the group; ``ntile`` takes its number as column."""
    by, order = spec.partition_by, spec.order_by
    part = {"percent_rank": "rank", "cume_dist": "count", "ntile": "row_number"}[spec.function]
    ranked = window_columns(
        df, [WindowSpec("_at", part, None, by, order), WindowSpec("_n", "count", None, by)], limit
    )
    at, n = F.col("_at"), F.col("_n")
    if spec.function == "percent_rank":
        value = F.when(n > 1, (at - 1) / (n - 1)).otherwise(0.0)
    elif spec.function == "cume_dist":
        value = at / n
    else:
        # The first n % k tiles hold one row more.
        k = int(spec.column)
        size, more = F.floor(n / k), n % k
        wide = more * (size + 1)
        narrow = more + F.floor((at - wide - 1) / F.greatest(size, F.lit(1))) + 1
        value = F.when(at <= wide, F.floor((at - 1) / (size + 1)) + 1).otherwise(narrow)
    return ranked.withColumn(spec.out, value).drop("_at", "_n")


def _whole_group(df: DataFrame, spec: WindowSpec) -> DataFrame:
    value = getattr(F, spec.function)(spec.column or F.lit(1)).alias(spec.out)
    if not spec.partition_by:
        return df.withColumn(spec.out, df.agg(value).scalar())
    per_group = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in spec.partition_by]).agg(value)
    on = F.lit(True)
    for k in spec.partition_by:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return df.join(per_group, on).drop(*[f"_g_{k}" for k in spec.partition_by])


def _key_names(order_by: Sequence[OrderKey]) -> list[str]:
    return [parse_key(k)[0] for k in order_by]


def _rank(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    keys = _key_names(spec.order_by)
    order, by = spec.order_by, spec.partition_by
    if spec.function == "row_number":
        return ordered_scan(df, by, order, [{spec.out: ("row_number", None)}], limit)

    def peers(d: DataFrame) -> DataFrame:
        return d.withColumn("_peer", F.struct(*keys))

    def starts(d: DataFrame) -> DataFrame:
        is_new = (F.col("_rn") == 1) | ~F.col("_peer").eqNullSafe(F.col("_prev"))
        mark = F.col("_rn") if spec.function == "rank" else F.lit(1).cast("long")
        other = F.lit(None) if spec.function == "rank" else F.lit(0).cast("long")
        return d.withColumn("_start", F.when(is_new, mark).otherwise(other))

    scan = "max" if spec.function == "rank" else "sum"
    return ordered_scan(
        df,
        by,
        order,
        [
            peers,
            {"_rn": ("row_number", None), "_prev": ("lag", "_peer")},
            starts,
            {spec.out: (scan, "_start")},
        ],
        limit,
    ).drop("_peer", "_rn", "_prev", "_start")


def _near(
    df: DataFrame,
    spec: WindowSpec,
    before: int,
    after: int,
    value: Callable[[Window], Column],
    limit: int | None,
) -> DataFrame:
    """A window value that looks at most ``before`` rows back and ``after`` rows on.

    Groups up to the limit use one plain window. Larger ones are numbered and cut into blocks; each block
    also gets the rows just outside it, and only its own rows keep their value.
    """
    by, order = list(spec.partition_by), spec.order_by
    limit = max(limit or ordering.ROWS_PER_TASK, before + after, 1)
    hot = hot_groups(df, by, limit)
    if hot is None:
        return df.withColumn(spec.out, value(Window.partitionBy(*by).orderBy(*sort_columns(order))))
    numbered = ordered_scan(df, by, order, [{"_at": ("row_number", None)}], limit)
    block = F.floor((F.col("_at") - 1) / limit)
    # A row also belongs to the block whose first rows look back to it, and to the one whose last rows look on.
    reach = [block, F.floor((F.col("_at") - 1 + before) / limit), F.floor((F.col("_at") - 1 - after) / limit)]
    spread = numbered.withColumns({"_own": block, "_block": F.explode(F.array_distinct(F.array(*reach)))})
    window = Window.partitionBy(*by, "_block").orderBy("_at")
    return spread.withColumn(spec.out, value(window)).where("_own = _block").drop("_at", "_own", "_block")


def _offset(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    reach = (spec.offset, 0) if spec.function == "lag" else (0, spec.offset)
    default = None if spec.default is None else spec.default
    return _near(df, spec, *reach, lambda w: getattr(F, spec.function)(spec.column, spec.offset, default).over(w), limit)


def _framed(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    """A ROWS frame: bounded on both sides, or from the first row to the current one."""
    first, last = spec.frame
    if first is None and last == 0:
        parts = {"avg": ["sum", "count"]}.get(spec.function, [spec.function])
        if spec.function == "stddev":
            raise ValueError("stddev has no running ROWS form; leave the frame out or bound it")
        scans = {f"_r_{p}": (p, spec.column) for p in parts}
        out = ordered_scan(df, spec.partition_by, spec.order_by, [scans], limit)
        value = F.col("_r_sum") / F.col("_r_count") if spec.function == "avg" else F.col(f"_r_{parts[0]}")
        return out.withColumn(spec.out, value).drop(*scans)
    if first is None and last is None:
        return _whole_group(df, spec)
    if first is None or last is None:
        raise ValueError("a frame is bounded on both sides, runs up to the current row, or covers the group")
    column = F.col(spec.column) if spec.column else F.lit(1)
    value = lambda w: getattr(F, spec.function)(column).over(w.rowsBetween(first, last))
    return _near(df, spec, max(0, -first), max(0, last), value, limit)


def _interval(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    """A RANGE frame: rows of the group whose value lies in [x + low, x + high] of the row's value x.

    Groups up to the limit use one plain window. Of larger ones only rows take part in ordered scans, so that a frame may be as
    wide as the group: sums and counts are differences of running totals at two probes, extremes come from the
    blocks that the frame touches. A NULL value frames the rows whose value is NULL.
    """
    low, high = spec.interval
    if low > high:
        raise ValueError("an interval goes from its lower to its upper end")
    (name, direction, _), *more = map(parse_key, spec.order_by)
    if more or direction != "asc":
        raise ValueError("an interval frame takes one ascending order column")
    if spec.function == "stddev":
        raise ValueError("stddev has no interval form")
    by, limit = list(spec.partition_by), limit or ordering.ROWS_PER_TASK
    column = F.col(spec.column) if spec.column else F.lit(1)
    timed = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    x = F.unix_micros(F.col(name).cast("timestamp")) if timed else F.col(name)
    unit = 1_000_000 if timed else 1
    ends = [int(e * unit) if timed or float(e).is_integer() else e for e in (low, high)]
    df = df.withColumn("_x", x)
    hot = hot_groups(df, by, limit)
    if hot is None:
        window = Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_last()).rangeBetween(*ends)
        return df.withColumn(spec.out, getattr(F, spec.function)(column).over(window)).drop("_x")
    rows = materialise(df.withColumns({"_v": column, "_row": F.monotonically_increasing_id()}), "interval-rows")
    placed = _probed(rows, by, ends, limit)
    if spec.function in ("sum", "count", "avg"):
        total, n = F.col("_sum_to") - F.col("_sum_from"), F.col("_count_to") - F.col("_count_from")
        value = {"count": n, "sum": F.when(n > 0, total), "avg": F.try_divide(total, n)}[spec.function]
        return placed.select(*[c for c in df.columns if c != "_x"], value.alias(spec.out))
    return _interval_extreme(rows, placed, by, spec, limit).select(*[c for c in df.columns if c != "_x"], spec.out)


def _probed(rows: DataFrame, by: Sequence[str], ends: Sequence[float], limit: int) -> DataFrame:
    """Rows with running totals just before the frame's first row (``_from``) and after its last one (``_to``).

    A row sends two probes, one to each end of its frame; a scan over rows and probes in order of value carries the totals to them.
    """
    numbers = ["_v", "_x"]
    data = rows.select(*by, F.col("_x").alias("_at"), F.lit(1).alias("_kind"), "_row", "_v", F.lit(1).alias("_one"))
    probe = lambda end, kind: rows.select(
        *by, (F.col("_x") + F.lit(end)).alias("_at"), F.lit(kind).alias("_kind"), "_row",
        F.lit(None).cast(rows.schema[numbers[0]].dataType).alias("_v"), F.lit(None).cast("int").alias("_one"),
    )
    # At one value the probe for the lower end comes before the rows, the other one after them.
    events = data.unionByName(probe(ends[0], 0)).unionByName(probe(ends[1], 2))
    summed = isinstance(rows.schema["_v"].dataType, T.NumericType)
    scans = {"_count": ("count", "_v"), "_rows": ("count", "_one")} | ({"_sum": ("sum", "_v")} if summed else {})
    run = ordered_scan(events, by, ["_at", "_kind", "_row"], [scans], limit).where("_kind <> 1")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sides = []
    for kind, side in ((0, "from"), (2, "to")):
        sides.append(run.where(F.col("_kind") == kind).select(F.col("_row").alias(f"_row_{side}"), *[zero(c).alias(f"{c}_{side}") for c in scans]))
    return rows.join(sides[0], F.col("_row") == F.col("_row_from")).join(sides[1], F.col("_row") == F.col("_row_to"))


#: Rows of a block of which an interval frame may take any part.
EXTREME_BLOCK = 1024


def _interval_extreme(rows: DataFrame, placed: DataFrame, by: Sequence[str], spec: WindowSpec, limit: int) -> DataFrame:
    """Least or largest value of the frame's rows, which are the places ``_rows_from`` + 1 .. ``_rows_to`` of the group.

    A frame inside one block of EXTREME_BLOCK rows is a slice of it. Any other is the end of its first block, the
    start of its last one, and the blocks between, which two overlapping runs of 2 ** k blocks cover (a sparse table).
    """
    size = min(limit, EXTREME_BLOCK)
    fn, pick = (F.min, F.least) if spec.function == "min" else (F.max, F.greatest)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{b}{k}")) for k in by], F.lit(True)) & a
    tagged = lambda df, p: df.select([F.col(c).alias(f"{p}{c}") for c in df.columns])
    block = lambda place: F.floor((place - 1) / size)
    at = materialise(ordered_scan(rows.select(*by, "_x", "_row", "_v"), by, ["_x", "_row"], [{"_place": ("row_number", None)}], limit), "places")
    at = at.withColumn("_block", block(F.col("_place")))
    window = Window.partitionBy(*by, "_block").orderBy("_place")
    scanned = at.withColumns({
        "_head": fn("_v").over(window.rowsBetween(Window.unboundedPreceding, 0)),
        "_tail": fn("_v").over(window.rowsBetween(0, Window.unboundedFollowing)),
    })
    scanned = materialise(scanned, "block-extremes")
    # The sparse table has a row for every block and power of two: rows / size of them times a logarithm.
    level = scanned.groupBy(*by, "_block").agg(fn("_v").alias("_best"))
    most = scanned.agg(F.max("_block")).first()[0] or 0
    table, k = level.withColumn("_k", F.lit(0)), 0
    while 2 << k <= most:
        next_ = tagged(level.withColumn("_block", F.col("_block") - (1 << k)), "o")
        level = level.join(next_, same(F.col("_block") == F.col("o_block"), "o"))
        level = materialise(level.select(*by, "_block", pick("_best", "o_best").alias("_best")), "sparse-table")
        k += 1
        table = table.unionByName(level.withColumn("_k", F.lit(k)))
    framed = placed.withColumns({"_first": F.col("_rows_from") + 1, "_last": F.col("_rows_to")})
    framed = framed.withColumns({"_fb": block(F.col("_first")), "_lb": block(F.col("_last"))})
    inside = framed.where("_first <= _last AND _fb = _lb")
    near = tagged(at.select(*by, "_block", "_place", "_v").groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_vs")), "i")
    values = F.slice("i_vs", (F.col("_first") - F.col("_fb") * size).cast("int"), (F.col("_last") - F.col("_first") + 1).cast("int"))["_v"]
    inside = inside.join(near, same(F.col("_fb") == F.col("i_block"), "i"))
    inside = inside.withColumn(spec.out, (F.array_min if spec.function == "min" else F.array_max)(values))
    wide = framed.where("_first <= _last AND _fb < _lb")
    ends = scanned.select(*by, "_place", "_head", "_tail")
    wide = wide.join(tagged(ends, "f"), same(F.col("_first") == F.col("f_place"), "f")).join(tagged(ends, "l"), same(F.col("_last") == F.col("l_place"), "l"))
    gap = F.col("_lb") - F.col("_fb") - 1
    power = F.when(gap > 0, F.floor(F.log2(gap.cast("double")) + 1e-9).cast("int"))
    wide = wide.withColumn("_p", power).withColumns({"_m1": F.col("_fb") + 1, "_m2": F.col("_lb") - F.expr("shiftleft(1L, _p)")})
    for side, start in (("a", "_m1"), ("b", "_m2")):
        wide = wide.join(tagged(table, side), same((F.col(start) == F.col(f"{side}_block")) & (F.col("_p") == F.col(f"{side}_k")), side), "left")
    wide = wide.withColumn(spec.out, pick("f_tail", "l_head", F.coalesce("a_best", "f_tail", "l_head"), F.coalesce("b_best", "f_tail", "l_head")))
    empty = framed.where("_first > _last").withColumn(spec.out, F.lit(None).cast(rows.schema["_v"].dataType))
    keep = [*rows.columns, spec.out]
    return inside.select(keep).unionByName(wide.select(keep)).unionByName(empty.select(keep))


def _value_at(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    """Values of the first, last or ``offset``-th row: one row per group, joined back.

    Without a frame the group is seen up to the current row: then last_value is the row's own value and
    nth_value is NULL before the n-th row. ``frame=(None, None)`` sees the whole group.
    """
    by, whole = list(spec.partition_by), spec.frame == (None, None)
    if spec.frame not in (None, (None, 0), (None, None)):
        raise ValueError(f"{spec.function} sees the group up to the current row or as a whole")
    if spec.function == "last_value" and not whole:
        return df.withColumn(spec.out, F.col(spec.column))
    order = reversed_order(spec.order_by) if spec.function == "last_value" else spec.order_by
    n = spec.offset if spec.function == "nth_value" else 1
    at = first_per_group(df, by, order, n) if by else df.orderBy(*sort_columns(order)).limit(n)
    if n > 1:
        at = _near(at, WindowSpec("_n", "row_number", None, by, order), 0, 0, lambda w: F.row_number().over(w), limit)
        at = at.where(F.col("_n") == n)
    at = at.select(*[F.col(k).alias(f"_g_{k}") for k in by], F.col(spec.column).alias(spec.out))
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    if spec.function == "nth_value" and not whole:
        df = ordered_scan(df, by, spec.order_by, [{"_at": ("row_number", None)}], limit)
        on = on & (F.col("_at") >= n)
    return df.join(at, on, "left").drop("_at", *[f"_g_{k}" for k in by])


def _running(df: DataFrame, spec: WindowSpec, limit: int | None) -> DataFrame:
    """Running aggregate with peers merged: scan one row per peer group, join back."""
    keys = [*spec.partition_by, *_key_names(spec.order_by)]
    column = F.col(spec.column) if spec.column else F.lit(1)
    parts = {"avg": ["sum", "count"], "stddev": ["sum", "count", "squares"]}.get(spec.function, [spec.function])
    if spec.function == "stddev":  # squares of distances from the overall mean lose less than plain squares
        column = column - df.agg(F.avg(spec.column)).scalar()
    forms = {"squares": lambda c: F.sum(c * c)}
    per_peer = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(
        *[forms.get(p, getattr(F, p, None))(column).alias(f"_p_{p}") for p in parts]
    )
    order = [
        (f"_g_{n}", d, nulls) for n, d, nulls in map(parse_key, spec.order_by)
    ]
    scans = {
        f"_r_{p}": ("sum" if p in ("sum", "count", "squares") else p, f"_p_{p}") for p in parts
    }
    run = ordered_scan(per_peer, [f"_g_{k}" for k in spec.partition_by], order, [scans], limit)
    total, n = F.col("_r_sum"), F.col("_r_count")
    if spec.function == "avg":
        value = F.try_divide(total, n)
    elif spec.function == "stddev":
        spread = F.col("_r_squares") - F.try_divide(total * total, n)
        value = F.sqrt(F.greatest(F.try_divide(spread, n - 1), F.lit(0.0)))
        value = F.when(n > 1, value)
    else:
        value = F.col(f"_r_{parts[0]}")
    run = run.select(*[f"_g_{k}" for k in keys], value.alias(spec.out))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return df.join(run, on).drop(*[f"_g_{k}" for k in keys])


def dedup_keep(df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey]) -> DataFrame:
    return first_per_group(df, keys, order, 1)


def waves(df: DataFrame, order: Sequence[OrderKey], size: int = 50, out: str = "wave") -> DataFrame:
    """Cut the ranked rows into blocks of ``size``."""
    return (
        dense_number(df, order, "_rn")
        .withColumn(out, F.floor((F.col("_rn") - 1) / size) + 1)
        .drop("_rn")
    )


def chunk_groups(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[OrderKey],
    size: int = 20,
    min_size: int = 2,
    out: str = "chunk",
    limit: int | None = None,
) -> DataFrame:
    """Batches of ``size`` rows inside each group; a last batch below ``min_size`` is dropped."""
    numbered = group_number(df, key, order, "_rn", limit)
    chunked = numbered.withColumn(out, F.floor((F.col("_rn") - 1) / size))
    sizes = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in key]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    left_over = F.col("_n") - F.col(out) * size
    return (
        chunked.join(sizes, on)
        .withColumn("chunk_size", F.least(left_over, F.lit(size)))
        .where(F.col("chunk_size") >= min_size)
        .drop("_rn", "_n", *[f"_g_{k}" for k in key])
    )


def budget_batches(
    df: DataFrame, order: Sequence[OrderKey], per_item: int = 500, budget: int = 15_000
) -> DataFrame:
    """Batches that stay within a budget at a constant cost per row."""
    return waves(df, order, max(1, budget // per_item), "batch")


def representatives(df: DataFrame, key: Sequence[str], member: str) -> DataFrame:
    """First member of each group and the size of the group."""
    return df.groupBy(*key).agg(
        F.min(member).alias("representative"), F.count(F.lit(1)).alias("n_members")
    )


def collapse_runs(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[OrderKey],
    value: str,
    n: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All or the first ``n`` runs of equal values per group: one row per run, with its number."""

    def starts(d: DataFrame) -> DataFrame:
        is_new = (F.col("_rn") == 1) | ~F.col(value).eqNullSafe(F.col("_prev"))
        return d.withColumn("_start", F.when(is_new, 1).otherwise(0).cast("long"))

    scanned = ordered_scan(
        df,
        key,
        order,
        [
            {"_rn": ("row_number", None), "_prev": ("lag", value)},
            starts,
            {"run": ("sum", "_start")},
        ],
        limit,
    )
    runs = scanned.where(F.col("_start") == 1)
    return (runs if n is None else runs.where(F.col("run") <= n)).select(*key, "run", value)


def normalise_by_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``1 - x / max(x)``; the maximum is a scalar subquery."""
    top = df.agg(F.max(column).alias("m")).scalar()
    return df.withColumn(out, F.lit(1) - F.col(column) / top)


def budget_alerts(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[OrderKey],
    cost: str,
    budget: float,
    threshold: float = 0.8,
    carried: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Running total per key with an ``ok`` / ``near`` / ``over`` flag.

    ``carried`` holds totals of earlier batches as (key, ``carried_total``).
    """
    typed = df.withColumn(cost, F.col(cost).cast("decimal(18,4)"))
    run = ordered_scan(typed, key, order, [{"running_total": ("sum", cost)}], limit)
    if carried is not None:
        old = carried.select(
            *[F.col(k).alias(f"_k_{k}") for k in key],
            F.col("carried_total").cast("decimal(28,4)"),
        )
        on = F.lit(True)
        for k in key:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        run = (
            run.join(old, on, "left")
            .withColumn(
                "running_total",
                F.col("running_total") + F.coalesce("carried_total", F.lit(0)),
            )
            .drop("carried_total", *[f"_k_{k}" for k in key])
        )
    total = F.col("running_total")
    bound = F.lit(str(budget)).cast("decimal(18,4)")
    near = F.lit(str(threshold)).cast("decimal(8,4)") * bound
    return run.withColumn(
        "alert",
        F.when(total >= bound, "over").when(total >= near, "near").otherwise("ok"),
    ).withColumns(
        {"running_total": total.cast("double"), cost: F.col(cost).cast("double")}
    )
