"""File, catalog and generated sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.operators.ordering import OrderKey
from stageloom.scratch import materialise

CORRUPT = "_corrupt_record"


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    keep_corrupt: bool = False,
) -> DataFrame:
    """Delimited text with a header. Compressed files are read by suffix.

    With ``keep_corrupt`` lines that do not fit the schema come back whole in ``_corrupt_record``.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"')
    if keep_corrupt:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT
        )
    return reader.schema(schema).csv(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the bad lines with the file they came from; the input is parsed once."""
    parsed = materialise(df.withColumn("_path", F.col("_metadata.file_path")), "parsed")
    good = parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_path")
    errors = parsed.where(F.col(CORRUPT).isNotNull()).select(
        F.col("_path").alias("path"), F.col(CORRUPT).alias("line")
    )
    return good, errors


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_grouped(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    group_bytes: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """All files below a folder; small files share a task up to ``group_bytes``.

    Spark packs files into tasks by itself; ``group_bytes`` merges its tasks, without a shuffle, to
    about that many bytes each.
    """
    reader = spark.read.format(fmt).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    if not group_bytes:
        return df
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return df.coalesce(max(1, -(-files.getContentSummary(folder).getLength() // group_bytes)))


def read_table(spark: SparkSession, name: str, where: str | Column | None = None) -> DataFrame:
    """Catalog table; a predicate on partition columns prunes partitions."""
    df = spark.table(name)
    return df if where is None else df.where(where)


def keyed_source(df: DataFrame, keys: Sequence[str], order: Sequence[OrderKey]) -> DataFrame:
    """Hashed-file view of a table: one row per key, the last write wins."""
    from stageloom.operators.cdc import latest_per_key

    return latest_per_key(df, keys, order)


def row_generator(spark: SparkSession, n: int, columns: Mapping[str, Column]) -> DataFrame:
    """``n`` rows of expressions over ``id``."""
    return spark.range(n).select(*[c.alias(name) for name, c in columns.items()])


def incremental_read(
    df: DataFrame, key: str, last=None, seen: DataFrame | None = None
) -> tuple[DataFrame, object]:
    """Rows that were not read before, and the new last key (unchanged if there are none with a key).

    ``seen`` holds the rows already read at the last key or without a key (``bookmark_rows``): a row that arrives late with
    the last key, or has none, is then read once. Without ``seen`` only rows after the last key are read. Rows that are equal in
    all columns of ``seen`` count as one.
    """
    if seen is not None:
        rows = df if last is None else df.where((F.col(key) >= F.lit(last)) | F.col(key).isNull())
        known = seen.toDF(*[f"_seen_{c}" for c in seen.columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_seen_{c}")) for c in seen.columns])
        fresh = rows.join(known, same, "left_anti")
    else:
        fresh = df if last is None else df.where(F.col(key) > F.lit(last))
    top = fresh.agg(F.max(key)).first()[0]
    return fresh, last if top is None else top


def bookmark_rows(
    fresh: DataFrame, key: str, top, seen: DataFrame | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """What the next ``incremental_read`` must know: the rows read at the last key and those without a key, stored by the caller.

    ``columns`` tell rows apart (by default all that can be compared); the key is always one of them.
    """
    compared = [f.name for f in fresh.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    columns = list(seen.columns) if seen is not None else list(dict.fromkeys([*(columns or compared), key]))
    rows = fresh.select(*columns)
    if seen is not None:
        rows = rows.unionByName(seen)
    return rows.where(F.col(key).isNull() | (F.col(key) == F.lit(top))).distinct()
