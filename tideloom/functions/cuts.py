"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one of this machine in local mode, and an error on a cluster, whose executors cannot see it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="tideloom-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
