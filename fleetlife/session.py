"""Session helpers: the shared work folder, checkpoints, and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 20_000
_local: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset: one temporary folder per
    process for a local master, and an error on a cluster, whose executors do not share local folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives the loss of executors)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(spark))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Join side for a table expected to be small. Up to ``limit`` rows it is computed once and
    broadcast; a larger one is returned as it is, so that the join shuffles (and AQE splits its
    hot keys) instead."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
