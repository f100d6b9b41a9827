"""Shared scratch space: where an operator cuts its lineage.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``, or below the
warehouse folder where that is unset; both are shared, so the tables outlive any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes what a query shuffled as soon as the query is done, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def run_dir(spark: SparkSession) -> str:
    """The folder that holds all scratch tables of this application."""
    return f"{shared_dir(spark)}/stageloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Delete the application's own scratch tables; results that read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the stored table.

    A stored table rather than an RDD checkpoint: later steps read only the
    columns they need, and rows keep the values they were written with even if
    the plan that made them would now give another order. What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
