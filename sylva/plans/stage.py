"""Intermediate relations written down: computed once, with known size, and lineage ends there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/sylva-checkpoints"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path in the application's own folder below the shared one, which may go when the application has ended."""
    return os.path.join(shared_folder(spark), f"sylva-{spark.sparkContext.applicationId}", f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
