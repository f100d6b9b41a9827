"""Stages with caller-supplied logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stageloom.operators.ordering import OrderKey, sort_columns


def custom_stage(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """DataFrame logic as a stage; also the hook behind a join or aggregate."""
    return df.transform(fn)


def custom_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Python row logic over Arrow batches. A batch is a slice of a partition, never a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


class GroupLogic:
    """Logic over one group that comes in slices, in order; an object is made for every group."""

    def start(self, key: dict) -> None:
        """The group's key values."""

    def rows(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A slice of the group's rows; none is seen twice, and none is kept unless the logic keeps it."""
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        """Called after the group's last slice."""
        return iter(())


def custom_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey], logic: Callable[[], GroupLogic], schema: str
) -> DataFrame:
    """Caller's logic over groups, each streamed in order and in slices of Arrow batches instead of being held.

    A group lies in one task, but no more of it than a batch is in memory at a time: its state is what the logic keeps. NULL
    keys form a group. Sorted on the JVM side, where the sort spills.
    """
    keys, names, wanted = list(keys), df.columns, to_arrow_schema(StructType.fromDDL(schema))
    by_key = [F.col(k).asc_nulls_first() for k in keys]
    placed = df.repartition(*keys).sortWithinPartitions(*by_key, *sort_columns(order))
    # Keys are compared by one text, which tells NULL from the empty text.
    mark = F.to_json(F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, None
        for batch in batches:
            marks, rows = batch.column("_mark"), batch.select(names)
            same = pc.equal(marks.slice(1), marks.slice(0, len(marks) - 1)).to_numpy(zero_copy_only=False) if len(marks) else []
            edges = [0, *(np.flatnonzero(~np.asarray(same, dtype=bool)) + 1).tolist(), len(rows)] if len(rows) else [0]
            for a, b in zip(edges, edges[1:]):
                if marks[a].as_py() != current:
                    if group is not None:
                        yield from (out.cast(wanted) for out in group.end())
                    current, group = marks[a].as_py(), logic()
                    group.start({k: rows.column(k)[a].as_py() for k in keys})
                yield from (out.cast(wanted) for out in group.rows(rows.slice(a, b - a)))
        if group is not None:
            yield from (out.cast(wanted) for out in group.end())

    return placed.withColumn("_mark", mark).mapInArrow(run, schema)
