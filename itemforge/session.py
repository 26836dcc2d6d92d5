"""Session defaults and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "itemforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; every one of them can be overridden."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared staging folder named by the cluster (``spark.checkpoint.dir``), if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a missing one is an error, but in local mode, which is one machine."""
    folder = checkpoint_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="itemforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder that the cluster names; a missing folder is an error.

    Only reliable checkpoints are used, so a lost executor never loses the staged rows.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: like ``stage``, and Spark knows its size when it plans joins with it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def filter_settled(df: DataFrame, condition) -> DataFrame:
    """Filter on costly computed columns without the optimizer copying their expressions below.

    The row marker makes the projection a barrier, so each column is computed once per row.
    """
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    return marked.filter(condition & (F.col("_at") >= 0)).drop("_at")


def dealt(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Rows of a plain scan dealt out for costly row work, so many a task and one task per core at least.

    Splits are no measure of that work: a file of small rows has few row groups, and splits beyond those are empty.
    The count comes from the file footers.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task)))


def spread(df: DataFrame, rows_per_task: int = 40_000) -> DataFrame:
    """Give CPU-heavy row work even tasks when the rows of a plain scan lie in fewer splits than there are cores.

    A split is empty when no row group begins in it, so splits are measured by their rows, which come from the file
    footers: a scan whose largest split holds no more than twice a core's share is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = splits.agg(F.max("n"), F.sum("n")).first()
    return df if (most or 0) * cores <= 2 * (rows or 0) else df.repartition(max(cores, -(-rows // rows_per_task)))
