"""Session settings and the shared workspace for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "latelane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are designed for.

    Shuffle partitions and split sizes stay the cluster's own choice; pass them
    through ``conf`` where they differ.  AQE coalesces small partitions and splits
    skewed ones, which is what the shuffle joins rely on for hot keys.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Folder for tables written between the steps of one job.

    It lies in the folder named in ``spark.checkpoint.dir``, else in the warehouse:
    both are shared by the executors, whatever the master is.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def use_checkpoints(spark: SparkSession) -> None:
    """Learners that cut their lineage do it in the cluster's checkpoint folder, or in the workspace where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{workspace(spark)}/checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the workspace."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back.

    Cuts the lineage at a table that outlives any executor, fixes the content of
    columns that depend on the partitioning, and gives Catalyst file sizes to plan with.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
