"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a temporary one is set in local mode; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """df written to the shared folder once, so that its branches neither repeat its work nor carry its expressions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
