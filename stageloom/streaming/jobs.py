"""Incremental jobs on Structured Streaming.

Every job takes a checkpoint folder, runs over what has arrived since the last run
(``availableNow``) and ends. Progress lives in the checkpoint, so a rerun after a
lost driver or executor goes on where the last finished batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stageloom.operators.cdc import latest_per_key
from stageloom.operators.ordering import OrderKey
from stageloom.sources import deltas
from stageloom.streaming import stateful


def read_files(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the tables carry one without zone (read as UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_once(query: StreamingQuery) -> None:
    query.awaitTermination()


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append new files to a parquet folder, each row once."""
    run_once(
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def per_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    run_once(
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def apply_changes(
    stream: DataFrame,
    base: str,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    checkpoint: str,
) -> None:
    """Upsert each batch as a delta; the last change per key wins. A repeated batch changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        changes = latest_per_key(batch, keys, order)
        deltas.upsert(changes, base, keys, batch=(checkpoint, batch_id))
        deltas.tidy(batch.sparkSession, base)

    per_batch(stream, checkpoint, step)


def keep_latest(
    stream: DataFrame,
    base: str,
    keys: Sequence[str],
    order: Sequence[OrderKey],
    checkpoint: str,
) -> None:
    """One row per key, the last in the given order over all batches, whatever order they come in."""

    def step(batch: DataFrame, batch_id: int) -> None:
        deltas.upsert(batch, base, keys, order, batch=(checkpoint, batch_id))
        deltas.tidy(batch.sparkSession, base)

    per_batch(stream, checkpoint, step)


def usage_per_window(
    stream: DataFrame, ts: str, by: Sequence[str], aggs: dict[str, Column], window: str, late: str
) -> DataFrame:
    """Totals per event-time window; combined map-side before the state."""
    return (
        event_time(stream, ts)
        .withWatermark(ts, late)
        .groupBy(F.window(ts, window), *by)
        .agg(*[c.alias(n) for n, c in aggs.items()])
        .select(F.col("window.start").alias("window_start"), *by, *aggs)
    )


def drop_repeats(stream: DataFrame, ts: str, keys: Sequence[str], ttl: str, late: str | None = None) -> DataFrame:
    """First request of a key, and the first one later than the TTL after the last kept one.

    Start the query inside ``stateful.rocksdb_state``. ``late`` says how late a request may arrive (the TTL if not given); a
    key's state goes when the watermark has passed its TTL.
    """
    return stateful.first_within(stream, ts, late or ttl, keys, _millis(stream.sparkSession, ttl))


def _millis(spark: SparkSession, interval: str) -> int:
    """An interval such as ``10 minutes`` in milliseconds."""
    zero = F.lit(0).cast("timestamp")
    return spark.range(1).select(F.unix_millis(zero + F.expr(f"INTERVAL {interval}"))).first()[0]


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str, cost: str) -> DataFrame:
    """Changes of a key's sessions: requests, cost, and sessions that a late row joined to another (``gone``).

    Write with ``write_changes`` by key and session_start, inside ``stateful.rocksdb_state``.
    """
    return stateful.session_changes(stream, ts, late, [key], _millis(stream.sparkSession, gap), cost)


def write_changes(
    result: DataFrame, out: str, keys: Sequence[str], checkpoint: str, deleted: str | None = None
) -> list[dict]:
    """Upsert what every batch changed of a result into a keyed table; the query's progress by batch.

    In update mode a batch gives only the windows or sessions that its rows touched, and state that the watermark has passed is
    dropped. A repeated batch changes nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        deltas.upsert(batch, out, keys, deleted=deleted, batch=(checkpoint, batch_id))
        deltas.tidy(batch.sparkSession, out)

    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run_once(query)
    return query.recentProgress


def running_budget(
    stream: DataFrame,
    out: str,
    key: Sequence[str],
    order: Sequence[OrderKey],
    cost: str,
    budget: float,
    checkpoint: str,
    ts: str = "ts",
    late: str = "0 seconds",
    ttl: str | None = None,
    threshold: float = 0.8,
) -> None:
    """Append rows with the running total of their key and an ``ok`` / ``near`` / ``over`` flag to a parquet folder, each once.

    The totals are state of the query. With ``ttl`` a key that is silent for that long starts again at zero.
    """
    ttl_ms = None if ttl is None else _millis(stream.sparkSession, ttl)
    rows = stateful.running_totals(stream, ts, late, key, order, cost, ttl_ms)
    total = (F.col("running_").cast("decimal(28,4)") / stateful.UNITS).cast("decimal(28,4)")
    bound = F.lit(str(budget)).cast("decimal(18,4)")
    near = F.lit(str(threshold)).cast("decimal(8,4)") * bound
    flag = F.when(total >= bound, "over").when(total >= near, "near").otherwise("ok")
    rows = rows.withColumns({"alert": flag, "running_total": total.cast("double"), cost: F.col("units_").cast("double") / stateful.UNITS})
    with stateful.rocksdb_state(stream.sparkSession):
        ingest(rows.drop("running_", "units_"), out, checkpoint)
