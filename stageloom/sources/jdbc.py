"""JDBC and Kafka connectors: thin options over the built-in sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Database kind -> JDBC URL form and driver class.
VENDORS = {
    "oracle": ("jdbc:oracle:thin:@//{host}/{database}", "oracle.jdbc.OracleDriver"),
    "db2": ("jdbc:db2://{host}/{database}", "com.ibm.db2.jcc.DB2Driver"),
    "sqlserver": (
        "jdbc:sqlserver://{host};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
    "teradata": ("jdbc:teradata://{host}/DATABASE={database}", "com.teradata.jdbc.TeraDriver"),
    "netezza": ("jdbc:netezza://{host}/{database}", "org.netezza.Driver"),
    "postgresql": ("jdbc:postgresql://{host}/{database}", "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift://{host}/{database}", "com.amazon.redshift.jdbc.Driver"),
}


def vendor_url(kind: str, host: str, database: str) -> tuple[str, str]:
    form, driver = VENDORS[kind]
    return form.format(host=host, database=database), driver


def key_predicates(key: str, n: int = 10) -> list[str]:
    """``n`` disjoint predicates that cover every key, NULL included."""
    parts = [f"MOD(ABS({key}), {n}) = {i}" for i in range(n)]
    parts[0] += f" OR {key} IS NULL"
    return parts


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    n: int = 10,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parallel read: one connection per predicate on an integer key."""
    return spark.read.jdbc(
        url, table, predicates=key_predicates(key, n), properties=dict(properties or {})
    )


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "append",
    properties: Mapping[str, str] | None = None,
) -> None:
    df.write.jdbc(url, table, mode=mode, properties=dict(properties or {}))


def read_kafka(
    spark: SparkSession, servers: str, topic: str, starting: str = "earliest"
) -> DataFrame:
    """Topic as a stream of (key, value, timestamp) text rows; needs the Kafka package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
        .select(
            F.col("key").cast("string"), F.col("value").cast("string"), "timestamp"
        )
    )
