"""Keyed tables that take frequent small upserts: deltas beside a base in buckets, merged when read.

An upsert writes its own rows as a delta and publishes it; nothing else is rewritten. A reader takes the base rows whose
keys no delta has, and of every other key the last row. ``compact`` folds deltas into the buckets that have
collected enough of them, and splits buckets that have grown: a bucket is named by the last ``depth`` bits of a hash of
the keys, so that splitting one leaves the others alone. Upserts never conflict: the later commit wins. A
compaction raises ConcurrentCommit if another one folded the same buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.operators.cdc import has_keys, last_per_key
from stageloom.operators.ordering import OrderKey
from stageloom.operators.sizing import broadcast_if_small, literal_table
from stageloom.scratch import materialise
from stageloom.sources import commits

#: Rows that a bucket should hold; larger ones are split when they are folded.
ROWS_PER_BUCKET = 4_000_000
#: A bucket is folded once its deltas hold this share of its rows.
FOLD_SHARE = 0.1
#: Deltas that wait before ``tidy`` looks at them, and that a reader has to put together at most.
SOME_DELTAS, MOST_DELTAS = 8, 64
HASH_BITS = 30
_HASH, _VERSION, _DELETED, _BUCKET = "_hash", "_version", "_deleted", "_bucket"


def _hashed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With the hash that names a row's bucket; rows with a NULL key, which match nothing, spread by all their columns."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in (_HASH, _DELETED)])))
    chosen = F.when(has_keys(keys), F.xxhash64(*keys)).otherwise(whole)
    return df.withColumn(_HASH, F.pmod(chosen, F.lit(1 << HASH_BITS)))


def _bucket_name(buckets: Sequence[dict]) -> Column:
    """The bucket of a row by its hash: the one of the buckets' depths whose last bits are a bucket."""
    names: dict[int, list[int]] = {}
    for b in buckets:
        names.setdefault(b["depth"], []).append(b["bits"])
    tails = {depth: F.col(_HASH).bitwiseAND(F.lit((1 << depth) - 1)) for depth in names}
    found = [F.when(tails[d].isin(bits), F.concat(F.lit(f"{d}-"), tails[d].cast("string"))) for d, bits in sorted(names.items())]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _name(bucket: dict) -> str:
    return f"{bucket['depth']}-{bucket['bits']}"


def _empty(keys: Sequence[str], order: Sequence[OrderKey]) -> dict:
    bucket = {"depth": 0, "bits": 0, "rows": 0, "folded": -1, "folder": None}
    return {"keys": list(keys), "order": [list(k) if isinstance(k, tuple) else k for k in order], "buckets": [bucket], "deltas": [], "batches": {}}


def _order(state: dict) -> list[OrderKey]:
    return [tuple(k) if isinstance(k, list) else k for k in state["order"]]


def upsert(
    changes: DataFrame,
    base: str,
    keys: Sequence[str],
    order: Sequence[OrderKey] = (),
    deleted: str | None = None,
    batch: tuple[str, int] | None = None,
    tries: int = 10,
) -> bool:
    """Add ``changes`` as a delta of the table at ``base``, which is made if it is not there.

    Only the changes are written. A key's later commit wins, unless the table was made with an ``order``: then the last
    row in that order wins, whenever it came. Of several changes with one key the last in ``order`` (else by all columns) counts.
    ``deleted`` names a boolean column that removes a key. ``batch`` = (source, number) makes a repeated batch a
    no-op: False is returned. Rows with a NULL key are always added.
    """
    spark = changes.sparkSession
    version, state = commits.latest(spark, base)
    if state and batch and state["batches"].get(batch[0], -1) >= batch[1]:
        return False
    removed = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    columns = [c for c in changes.columns if c != deleted]
    rows = materialise(_hashed(changes.select(*columns, removed.alias(_DELETED)), keys), "changes")
    own_order = _order(state) if state else list(order)
    rows = last_per_key(rows, keys, own_order or list(order) or [c for c in columns if c not in keys] or list(keys))
    folder = f"data/{uuid.uuid4().hex}"
    rows.hint("rebalance").write.parquet(f"{base}/{folder}")
    for _ in range(tries):
        version, state = commits.latest(spark, base)
        state = state or _empty(keys, order)
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            commits.drop_folder(spark, base, folder)
            return False
        if batch:
            state["batches"][batch[0]] = batch[1]
        state["deltas"].append({"folder": folder, "version": version + 1})
        if commits.publish(spark, base, version + 1, state):
            commits.prune(spark, base)
            return True
    raise commits.ConcurrentCommit(f"no free number for {base} in {tries} tries")


def _deltas(spark: SparkSession, base: str, state: dict) -> DataFrame | None:
    """Rows of deltas that their bucket has not folded yet, with version and bucket."""
    if not state["deltas"]:
        return None
    parts = []
    for d in state["deltas"]:
        rows = spark.read.parquet(f"{base}/{d['folder']}")
        # A gathered delta holds rows of several versions and says which.
        parts.append(rows if d.get("gathered") else rows.withColumn(_VERSION, F.lit(d["version"]).cast("long")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.withColumn(_BUCKET, _bucket_name(state["buckets"]))
    # One row for each bucket that has folded something.
    folded = [(_name(b), b["folded"]) for b in state["buckets"] if b["folded"] >= 0]
    if folded:
        rows = rows.join(broadcast_if_small(literal_table(spark, folded, "_b string, _folded long")), F.col(_BUCKET) == F.col("_b"), "left")
        rows = rows.where(F.col("_folded").isNull() | (F.col(_VERSION) > F.col("_folded"))).drop("_b", "_folded")
    return rows


def _base(spark: SparkSession, base: str, buckets: Sequence[dict]) -> DataFrame | None:
    paths = [f"{base}/{b['folder']}/{_BUCKET}={_name(b)}" for b in buckets if b["rows"]]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def _merged(rows: DataFrame | None, deltas: DataFrame | None, state: dict) -> DataFrame | None:
    """Base rows and deltas as one table with the hash: the last row of each key, without removed ones."""
    if deltas is None or rows is None:
        if deltas is None:
            return rows
        last = last_per_key(deltas, state["keys"], [*_order(state), _VERSION])
        return last.where(~F.col(_DELETED)).drop(_DELETED, _VERSION, _BUCKET)
    keys, order = state["keys"], [*_order(state), _VERSION]
    changed = deltas.where(has_keys(keys)).select(*keys).distinct()
    changed = broadcast_if_small(changed)
    kept = rows.join(changed, list(keys), "left_anti")
    if state["order"]:
        # An older row may come later: the base rows of changed keys take part.
        rivals = rows.join(changed, list(keys), "left_semi").withColumns({_VERSION: F.lit(-1).cast("long"), _DELETED: F.lit(False)})
        deltas = deltas.unionByName(rivals, allowMissingColumns=True)
    last = last_per_key(deltas, keys, order).where(~F.col(_DELETED)).drop(_DELETED, _VERSION, _BUCKET)
    return kept.unionByName(last, allowMissingColumns=True)


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    """The table as of its newest commit, or of an earlier one that is still kept; None if there is none."""
    number, state = commits.latest(spark, base, None if version is None else version + 1)
    if state is None or (version is not None and number != version):
        return None
    rows = _merged(_base(spark, base, state["buckets"]), _deltas(spark, base, state), state)
    return None if rows is None else rows.drop(_HASH)


def _children(bucket: dict, rows: int, limit: int) -> list[dict]:
    """The bucket, or its children by the next bits of the hash if that many rows should not share one."""
    more = 0
    while rows > limit << more and bucket["depth"] + more < HASH_BITS:
        more += 1
    depth = bucket["depth"] + more
    return [bucket | {"depth": depth, "bits": bucket["bits"] | (i << bucket["depth"])} for i in range(1 << more)]


def tidy(spark: SparkSession, base: str) -> None:
    """What a job does after each of many small upserts: nothing while few deltas wait, else fold what is worth it and gather the rest."""
    state = commits.latest(spark, base)[1]
    if state is None or len(state["deltas"]) < SOME_DELTAS:
        return
    compact(spark, base)
    state = commits.latest(spark, base)[1]
    if len(state["deltas"]) >= MOST_DELTAS:
        gather(spark, base)


def gather(spark: SparkSession, base: str) -> bool:
    """Write all deltas as one, with the last row of each key; buckets stay as they are. False if there are fewer than two.

    Upserts and compactions may go on meanwhile: rows that a bucket has folded by then are passed over by their version.
    """
    state = commits.latest(spark, base)[1]
    if state is None or len(state["deltas"]) < 2:
        return False
    old, folder = {d["folder"] for d in state["deltas"]}, f"data/{uuid.uuid4().hex}"
    rows = materialise(_deltas(spark, base, state), "live-deltas")
    rows = last_per_key(rows, state["keys"], [*_order(state), _VERSION]).drop(_BUCKET)
    rows.hint("rebalance").write.parquet(f"{base}/{folder}")
    newest = max(d["version"] for d in state["deltas"])
    while True:
        at, now = commits.latest(spark, base)
        rest = [d for d in now["deltas"] if d["folder"] not in old]
        if len(rest) == len(now["deltas"]):
            commits.drop_folder(spark, base, folder)  # all were folded or gathered by another job
            return False
        if any(d.get("gathered") and d["version"] >= newest for d in rest):
            commits.drop_folder(spark, base, folder)
            raise commits.ConcurrentCommit(f"another job gathered the deltas of {base}")
        now["deltas"] = [{"folder": folder, "version": newest, "gathered": True}, *rest]
        if commits.publish(spark, base, at + 1, now):
            commits.prune(spark, base)
            return True


def compact(
    spark: SparkSession, base: str, rows_per_bucket: int = ROWS_PER_BUCKET, share: float = FOLD_SHARE
) -> int:
    """Fold deltas into buckets whose deltas hold ``share`` of their rows or more; the number of folded buckets.

    Other buckets keep their files. A folded bucket above ``rows_per_bucket`` is split. Upserts may go on meanwhile: they
    stay deltas on top. Raises ConcurrentCommit, and changes nothing, if another compaction took one of the buckets.
    """
    version, state = commits.latest(spark, base)
    if state is None or not state["deltas"]:
        return 0
    deltas = materialise(_deltas(spark, base, state), "live-deltas")
    waiting = dict(deltas.groupBy(_BUCKET).agg(F.count(F.lit(1))).collect())  # one row a bucket
    due = [b for b in state["buckets"] if waiting.get(_name(b), 0) > 0 and waiting[_name(b)] >= share * b["rows"]]
    names = {_name(b) for b in due}
    folder, new = f"data/{uuid.uuid4().hex}", []
    if due:
        new = [c for b in due for c in _children(b, b["rows"] + waiting[_name(b)], rows_per_bucket)]
        rows = _merged(_base(spark, base, due), deltas.where(F.col(_BUCKET).isin(list(names))), state)
        rows = rows.withColumn(_BUCKET, _bucket_name(new))
        rows.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{base}/{folder}")
        written = spark.read.schema(f"{_BUCKET} string").option("basePath", f"{base}/{folder}").parquet(f"{base}/{folder}")
        counts = dict(written.groupBy(_BUCKET).agg(F.count(F.lit(1))).collect())
        new = [b | {"rows": counts.get(_name(b), 0), "folded": version, "folder": folder} for b in new]
    before = {_name(b): b for b in state["buckets"]}
    while True:
        at, now = commits.latest(spark, base)
        have = {_name(b): b for b in now["buckets"]}
        if any(have.get(n) != before[n] for n in names):
            commits.drop_folder(spark, base, folder)
            raise commits.ConcurrentCommit(f"another compaction folded buckets of {base}")
        # A bucket without waiting rows has nothing to fold up to the version that was read.
        still = [
            b | {"folded": max(b["folded"], version)} if n in before and before[n] == b and not waiting.get(n) else b
            for n, b in have.items() if n not in names
        ]
        now["buckets"] = still + new
        oldest = min(b["folded"] for b in now["buckets"])
        now["deltas"] = [d for d in now["deltas"] if d["version"] > oldest]
        if commits.publish(spark, base, at + 1, now):
            commits.prune(spark, base)
            return len(due)
