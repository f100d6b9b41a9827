"""Size checks in front of a broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_ROWS = 200_000
MAX_BYTES = 32 * 1024 * 1024


def broadcast_if_small(
    df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Hint a broadcast only if the table is measured to be small.

    The measurement looks at no more than ``max_rows + 1`` rows. A larger table comes back
    without a hint and joins by shuffle, where AQE splits skewed partitions.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, chars = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)))
        .first()
    )
    return F.broadcast(df) if rows <= max_rows and chars <= max_bytes else df


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows written in code as a local relation: no Python job to scan it."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
