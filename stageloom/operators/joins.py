"""Joins and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators import ordering
from stageloom.operators.sizing import broadcast_if_small
from stageloom.scratch import materialise


#: Slots of the hash by which rows are counted before keys are.
SLOTS = 1 << 16

#: A hot key is cut into pieces of this share of a task's rows, so that pieces even out over tasks.
PIECES = 16


def join_stage(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join on key lists; broadcast or shuffle is left to Catalyst and AQE, but for full joins (``full_join``)."""
    if how in ("full", "outer", "fullouter", "full_outer"):
        return full_join(left, right, left_keys, right_keys)
    if right_keys is None or list(left_keys) == list(right_keys):
        return left.join(right, list(left_keys), how)
    on = reduce(
        lambda a, b: a & b, [left[a] == right[b] for a, b in zip(left_keys, right_keys)]
    )
    return left.join(right, on, how)


def null_salt(df: DataFrame, complete: Column) -> Column:
    """0 where keys are complete, else a hash of the whole row: it spreads rows that match nothing, alike in every attempt of a task."""
    return F.when(complete, F.lit(0).cast("long")).otherwise(F.xxhash64(F.to_json(F.struct(*[df[c] for c in df.columns]))))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """(keys, n) of keys with more than ``limit`` rows, or None; NULL keys are not counted.

    Rows are first counted by SLOTS values of a hash, which shuffles next to nothing; keys only in slots above the limit.
    """
    whole = df.dropna(subset=list(keys)).select(*keys)
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    slots = whole.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    heavy = [r._slot for r in slots.select("_slot").collect()]  # at most SLOTS
    if not heavy:
        return None
    counts = whole.where(slot.isin(heavy)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.where(F.col("n") > limit), "hot-keys")
    return None if counts.isEmpty() else counts


def full_join(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Full outer equi-join in which no key, and no NULL, goes to one task. AQE does not split full joins.

    Keys with more than ``limit`` rows on a side (ROWS_PER_TASK) join apart: both sides are dealt to the cells of a grid, whose
    rows and columns follow the key's rows on each side; hot keys that the other side lacks are added as they are.
    Columns and rows are those of ``DataFrame.join``: with equal key names the keys come first, once.
    """
    limit = limit or ordering.ROWS_PER_TASK
    named = right_keys is None or list(left_keys) == list(right_keys)
    right_keys = list(left_keys) if right_keys is None else right_keys
    sides = {"_l": left, "_r": right}
    at = {"_l": [left.columns.index(k) for k in left_keys], "_r": [right.columns.index(k) for k in right_keys]}
    plain = {p: df.toDF(*[f"{p}{i}" for i in range(len(df.columns))]) for p, df in sides.items()}
    keys = {p: [f"{p}{i}" for i in at[p]] for p in sides}
    k_names = [f"_k{i}" for i in range(len(left_keys))]
    found = [hot_keys(plain[p], keys[p], limit) for p in sides]
    found = [h.select(*[F.col(c).alias(k) for c, k in zip(keys[p], k_names)]) for p, h in zip(sides, found) if h is not None]

    def on_keys(p: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c) == F.col(k) for c, k in zip(keys[p], k_names)])

    def whole(p: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys[p]])

    rest, parts = plain, []
    if found:
        hot = reduce(lambda a, b: a.unionByName(b), found).distinct()
        for p in sides:
            counts = plain[p].join(broadcast_if_small(hot), on_keys(p), "inner").groupBy(*k_names).agg(F.count(F.lit(1)).alias(f"n{p}"))
            hot = materialise(hot.join(counts, k_names, "left").withColumn(f"n{p}", F.coalesce(f"n{p}", F.lit(0))), "hot-keys")
        piece = max(1, limit // PIECES)
        hot = broadcast_if_small(hot.withColumns({f"cut{p}": F.ceil(F.greatest(F.col(f"n{p}"), F.lit(1)) / piece) for p in sides}))
        rest = {p: plain[p].join(hot.select(*k_names), on_keys(p), "left_anti") for p in sides}
        cells, other = {}, {"_l": "_r", "_r": "_l"}
        for p, q in other.items():
            rows = plain[p].join(hot, on_keys(p), "inner")
            parts.append(rows.where(F.col(f"n{q}") == 0).select(*plain[p].columns))
            mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(f"cut{p}")).alias(f"own{p}")
            # Stored, so that a repeated task deals every row to the same cell.
            dealt = materialise(rows.where(F.col(f"n{q}") > 0), "hot-rows").select(*plain[p].columns, f"cut{q}", mine)
            cells[p] = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"cut{q}") - 1)).alias(f"any{q}"))
        same = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(keys["_l"], keys["_r"])])
        cell = same & (F.col("own_l") == F.col("any_l")) & (F.col("any_r") == F.col("own_r"))
        parts.append(cells["_l"].join(cells["_r"], cell).select(*plain["_l"].columns, *plain["_r"].columns))
    # A salt spreads the rows with a NULL key, which match nothing.
    salted = {
        p: df.withColumn(f"salt{p}", null_salt(df, whole(p)))
        for p, df in rest.items()
    }
    on = reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(keys["_l"], keys["_r"])])
    joined = salted["_l"].join(salted["_r"], on & (F.col("salt_l") == F.col("salt_r")), "full").drop("salt_l", "salt_r")
    for part in parts:
        joined = joined.unionByName(part, allowMissingColumns=True)
    out = []
    if named:
        out += [F.coalesce(a, b).alias(k) for a, b, k in zip(keys["_l"], keys["_r"], left_keys)]
    for p, df in sides.items():
        out += [F.col(f"{p}{i}").alias(c) for i, c in enumerate(df.columns) if not (named and i in at[p])]
    return joined.select(*out)


@dataclass
class LookupSpec:
    name: str
    table: DataFrame
    main_key: str
    lookup_key: str
    columns: Sequence[str]
    how: str = "left"
    defaults: Mapping[str, object] = field(default_factory=dict)
    cache: bool = False
    _kept: list = field(default_factory=list, repr=False, compare=False)

    def stored(self) -> DataFrame:
        """The reference table's needed columns, written by the first use and read by all."""
        if not self._kept:
            columns = dict.fromkeys([self.lookup_key, *self.columns])
            self._kept.append(materialise(self.table.select(*columns), f"lookup-{self.name}"))
        return self._kept[0]


def lookup(df: DataFrame, spec: LookupSpec, miss_only: bool = False) -> DataFrame:
    """Add ``<lookup>_<column>`` columns from a reference table.

    ``cache`` stores the reference table once in the shared scratch folder for several outputs.
    Defaults replace a NULL result; with ``miss_only`` a NULL of a found row stays NULL.
    """
    key, hit = f"_{spec.name}_key", f"_{spec.name}_hit"
    names = {c: f"{spec.name}_{c}" for c in spec.columns}
    source = spec.stored() if spec.cache else spec.table
    table = source.select(
        F.col(spec.lookup_key).alias(key),
        F.lit(True).alias(hit),
        *[F.col(c).alias(n) for c, n in names.items()],
    )
    joined = df.join(
        broadcast_if_small(table), df[spec.main_key] == F.col(key), spec.how
    )
    filled = {}
    for c, value in spec.defaults.items():
        n = names[c]
        filled[n] = (
            F.when(F.col(hit).isNull(), F.lit(value)).otherwise(F.col(n))
            if miss_only
            else F.coalesce(F.col(n), F.lit(value))
        )
    if filled:
        joined = joined.withColumns(filled)
    return joined.drop(key, hit)


def lookup_chain(df: DataFrame, specs: Sequence[LookupSpec]) -> DataFrame:
    return reduce(lookup, specs, df)


def new_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not have."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def kept_rows(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key the source does not have."""
    return new_rows(target, source, keys)


def changed_rows(
    source: DataFrame, target: DataFrame, keys: Sequence[str], hash_column: str
) -> DataFrame:
    """Source rows whose key exists in the target with another hash."""
    old = target.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys], F.col(hash_column).alias("_t_hash")
    )
    on = reduce(
        lambda a, b: a & b, [F.col(k) == F.col(f"_t_{k}") for k in keys]
    ) & (F.col(hash_column) != F.col("_t_hash"))
    return source.join(old, on, "left_semi")


def merge_stage(master: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Master rows with values of a matching update row; extra update columns are appended."""
    shared = [c for c in master.columns if c in updates.columns and c not in keys]
    extra = [c for c in updates.columns if c not in master.columns]
    update = updates.select(
        *keys, *[F.col(c).alias(f"_u_{c}") for c in shared], *extra
    )
    return master.join(update, list(keys), "left").select(
        *[
            F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
            for c in master.columns
        ],
        *extra,
    )


def star_join(
    main: DataFrame,
    lookups: Sequence[tuple[DataFrame, Column]] = (),
    sources: Sequence[tuple[DataFrame, Column]] = (),
) -> DataFrame:
    """Extra sources join inner, lookups join left."""
    for other, on in sources:
        main = main.join(other, on, "inner")
    for other, on in lookups:
        main = main.join(other, on, "left")
    return main


def group_links(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Compare each group through its first member: (representative, member) pairs, i < j.

    A group of n members gives n - 1 pairs, so that a hot group stays linear.
    """
    first = df.groupBy(*keys).agg(F.min(member).alias("left_id"))
    return (
        df.select(*keys, F.col(member).alias("right_id"))
        .join(first, list(keys))
        .where(F.col("left_id") < F.col("right_id"))
        .select(*keys, "left_id", "right_id")
        .distinct()
    )


def uncompared_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a stored result; a result counts in either direction."""

    def canonical(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "_a": F.least("left_id", "right_id"),
                "_b": F.greatest("left_id", "right_id"),
            }
        )

    return (
        canonical(pairs)
        .join(canonical(done).select("_a", "_b"), ["_a", "_b"], "left_anti")
        .drop("_a", "_b")
    )
