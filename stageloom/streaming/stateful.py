"""Stateful processors: running budgets, repeats within a TTL and sessions, with their state in RocksDB.

State belongs to a key, survives batches and restarts with the query's checkpoint, and is dropped by event-time timers
once the watermark says that no row can need it. Keys are dealt to buckets: a bucket's state is read and written once a batch
and its rows are worked on together, as calls and round trips per key would cost more than the work. A bucket's rows of one
micro-batch meet in one task; the size of a batch (``files_per_batch``) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from stageloom.operators.ordering import OrderKey, parse_key

BUCKETS = 1024  # fixed: a query's checkpoint holds its state by bucket
UNITS = 10_000  # money in whole ten-thousandths
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, outside the JVM's heap; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def units(cost: str) -> Column:
    """An amount in whole ten-thousandths."""
    return (F.col(cost).cast("decimal(18,4)") * UNITS).cast("long")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _key_text(rows: DataFrame, by: Sequence[str]) -> Column:
    """The key as one text; equal for the rows that ``groupBy`` would put together, and for no others."""
    parts = []
    for name in by:
        part, kind = F.col(name), rows.schema[name].dataType
        if isinstance(kind, T.TimestampType):
            part = F.unix_micros(part)
        elif isinstance(kind, T.BinaryType):
            part = F.hex(part)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            part = F.when(part == 0, F.lit(0.0)).otherwise(part)
        parts.append(part.cast("string"))
    return F.to_json(F.array(*parts))


def _stateful(rows: DataFrame, by: Sequence[str], processor: _Buckets, fields: Sequence[T.StructField], mode: str) -> DataFrame:
    """Columns ``fields`` that the processor gives.

    Pandas holds whole numbers with a NULL among them as doubles, which are not exact: NULLs travel as zeros with a flag.
    """
    given = {f.name for f in fields}
    whole = [f.name for f in rows.schema.fields if f.name in given and isinstance(f.dataType, T.IntegralType)]
    flags = [T.StructField(f"{c}_null_", T.BooleanType()) for c in whole]
    key = _key_text(rows, by)
    rows = rows.withColumn("key_", key).withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(BUCKETS)).cast("int"))
    rows = rows.withColumns({f"{c}_null_": F.col(c).isNull() for c in whole}).fillna(0, whole)
    processor.names = rows.columns
    processor.carried = [f.name for f in fields if f.name in rows.columns] + [f.name for f in flags]
    found = rows.groupBy("bucket_").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType([*fields, *flags]), outputMode=mode, timeMode="EventTime"
    )
    return found.select(*[F.when(~F.col(f"{f.name}_null_"), F.col(f.name)).alias(f.name) if f.name in whole else f.name for f in fields])


def _sorted(rows: Iterator[pd.DataFrame], names: Sequence[str], order: Sequence[OrderKey]) -> pd.DataFrame:
    """A bucket's rows of one batch in order. Names are set anew: those that are no Python names arrive as numbers."""
    whole = pd.concat(list(rows), ignore_index=True).set_axis(list(names), axis=1)
    for name, direction, nulls in reversed([parse_key(k) for k in order]):
        values, flag = whole[name], f"{name}_null_"
        if flag in whole:
            values = values.astype("Int64").mask(whole[flag])
        whole = whole.loc[values.sort_values(ascending=direction == "asc", na_position=nulls, kind="stable").index]
    return whole


class _Buckets(StatefulProcessor):
    """Rows of state of all keys of a bucket, each with the time at which it is dropped; one timer a bucket.

    ``columns`` are those of the state beside ``key_`` and ``expiry`` (never if NULL).
    """

    columns: Sequence[str] = ("value",)
    names: list[str]
    carried: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "rows binary, timer long")

    def load(self) -> tuple[pd.DataFrame, int | None]:
        found = self.state.get()
        if found is None:
            empty = pd.DataFrame({"key_": pd.Series(dtype="object"), **{c: pd.Series(dtype="int64") for c in (*self.columns, "expiry")}})
            return empty, None
        with pa.ipc.open_stream(bytes(found[0])) as stream:
            return stream.read_all().to_pandas(), found[1]

    def store(self, rows: pd.DataFrame, timer: int | None, now: int) -> None:
        """Keep what is not past its time at ``now``."""
        rows = rows[~(rows["expiry"] < now).fillna(False).astype(bool)]
        first = rows["expiry"].min() if len(rows) else None
        first = None if first is None or pd.isna(first) else max(int(first), now)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if rows.empty:
            self.state.clear()
            return
        schema = pa.schema([("key_", pa.string()), *((c, pa.int64()) for c in (*self.columns, "expiry"))])
        batch = pa.RecordBatch.from_pandas(rows, schema, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            stream.write_batch(batch)
        self.state.update((sink.getvalue().to_pybytes(), first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, _ = self.load()
        # This timer is gone already.
        self.store(rows, None, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class RunningTotal(_Buckets):
    """Rows in order with the total of their key so far; a key that is silent for the TTL starts again."""

    def __init__(self, order: Sequence[OrderKey], ttl: int | None):
        self.order, self.ttl = list(order), ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = _sorted(rows, self.names, self.order)
        state, timer = self.load()
        before = state.set_index("key_")
        keys = whole["key_"]
        carried = keys.map(before["value"]).fillna(0).astype("int64")
        running = whole["units_"].fillna(0).astype("int64").groupby(keys).cumsum() + carried
        new = pd.DataFrame({"key_": keys, "value": running}).drop_duplicates("key_", keep="last")
        new["expiry"] = pd.Series(pd.NA, new.index, "Int64")
        if self.ttl is not None:
            latest = (whole["micros_"].groupby(keys).max() // 1000 + self.ttl).astype("int64")
            new["expiry"] = pd.concat([new["key_"].map(latest), new["key_"].map(before["expiry"])], axis=1).max(axis=1).astype("Int64")
        left = state[~state["key_"].isin(new["key_"])].astype({"expiry": "Int64"})
        self.store(pd.concat([left, new], ignore_index=True), timer, timerValues.getCurrentWatermarkInMs())
        yield whole[self.carried].assign(running_=running)


class FirstWithinTtl(_Buckets):
    """The first row of a key, and the first one later than the TTL after the last kept one."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = _sorted(rows, self.names, ["micros_"])
        state, timer = self.load()
        last = dict(zip(state["key_"], state["value"].tolist(), strict=True))
        kept = []
        for at, (name, micros_) in enumerate(zip(whole["key_"].tolist(), whole["micros_"].tolist(), strict=True)):
            before = last.get(name)
            if before is None or micros_ - before > self.ttl * 1000:
                kept.append(at)
                last[name] = micros_
        new = pd.DataFrame({"key_": list(last), "value": list(last.values())})
        new["expiry"] = new["value"] // 1000 + self.ttl + 1
        self.store(new, timer, timerValues.getCurrentWatermarkInMs())
        yield whole[self.carried].iloc[kept]


class Sessions(_Buckets):
    """Open sessions of the keys; every batch gives the sessions that changed, and those that another one swallowed."""

    columns = ("start", "end", "requests", "units")

    def __init__(self, keys: Sequence[str], gap: int):
        self.keys, self.gap = list(keys), gap  # in milliseconds, as timers are

    def _merged(self, found: pd.DataFrame) -> pd.DataFrame:
        """Sessions no more than the gap apart made one."""
        found = found.sort_values(["key_", "start", "end"], kind="stable")
        reach = found.groupby("key_")["end"].cummax().groupby(found["key_"]).shift()
        new = (reach.isna() | (found["start"] - reach > self.gap * 1000)).cumsum()
        return found.groupby(new).agg(
            key_=("key_", "first"), start=("start", "min"), end=("end", "max"), requests=("requests", "sum"), units=("units", "sum")
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = _sorted(rows, self.names, ["micros_"])
        state, timer = self.load()
        names = whole.drop_duplicates("key_")
        before = state[state["key_"].isin(names["key_"])].drop(columns="expiry")
        rows_ = pd.DataFrame({"key_": whole["key_"], "start": whole["micros_"], "end": whole["micros_"], "requests": 1, "units": whole["amount_"]})
        merged = self._merged(pd.concat([before, rows_], ignore_index=True))
        both = merged.merge(before, how="left", on=["key_", "start"], suffixes=("", "_old"))
        same = (both["end"] == both["end_old"]) & (both["requests"] == both["requests_old"]) & (both["units"] == both["units_old"])
        gone = before.merge(merged[["key_", "start"]], how="left", on=["key_", "start"], indicator=True)
        gone = gone[gone["_merge"] == "left_only"].assign(requests=0, units=0)
        out = pd.concat([both[~same].assign(gone=False), gone.assign(gone=True)], ignore_index=True)
        out = out[["key_", "start", "requests", "units", "gone"]].rename(columns={"start": "start_", "units": "units_"})
        kept = merged.assign(expiry=merged["end"] // 1000 + self.gap)
        left = state[~state["key_"].isin(names["key_"])]
        self.store(pd.concat([left, kept], ignore_index=True), timer, timerValues.getCurrentWatermarkInMs())
        yield out.merge(names[["key_", *self.carried]], on="key_")


def running_totals(
    stream: DataFrame, ts: str, late: str, key: Sequence[str], order: Sequence[OrderKey], cost: str, ttl_ms: int | None = None
) -> DataFrame:
    """Rows with ``running_``, their key's total so far in ten-thousandths, and ``units_``, their own. NULL costs add nothing."""
    rows = stream.withColumns({"units_": units(cost), "micros_": micros(ts)}).withColumn("event_", F.col(ts).cast("timestamp"))
    fields = [*rows.select(*stream.columns, "units_").schema.fields, T.StructField("running_", T.LongType())]
    return _stateful(rows.withWatermark("event_", late), key, RunningTotal(order, ttl_ms), fields, "Append")


def first_within(stream: DataFrame, ts: str, late: str, keys: Sequence[str], ttl_ms: int) -> DataFrame:
    """Rows of a key that no kept row of the TTL before them repeats."""
    rows = stream.withColumn("micros_", micros(ts)).withColumn("event_", F.col(ts).cast("timestamp"))
    return _stateful(rows.withWatermark("event_", late), keys, FirstWithinTtl(ttl_ms), stream.schema.fields, "Append")


def session_changes(stream: DataFrame, ts: str, late: str, keys: Sequence[str], gap_ms: int, cost: str) -> DataFrame:
    """(keys, session_start, requests, cost, gone) of sessions that a batch changed; ``gone`` ones became part of another."""
    rows = stream.select(*keys, units(cost).alias("amount_"), micros(ts).alias("micros_"), F.col(ts).cast("timestamp").alias("event_"))
    rows = rows.fillna(0, ["amount_"])
    fields = [*stream.select(*keys).schema.fields, T.StructField("start_", T.LongType()), T.StructField("requests", T.LongType())]
    fields += [T.StructField("units_", T.LongType()), T.StructField("gone", T.BooleanType())]
    found = _stateful(rows.withWatermark("event_", late), keys, Sessions(keys, gap_ms), fields, "Update")
    cost_ = (F.col("units_").cast("decimal(28,4)") / UNITS).cast("decimal(28,4)")
    return found.select(*keys, F.timestamp_micros("start_").alias("session_start"), "requests", cost_.alias("cost"), "gone")
