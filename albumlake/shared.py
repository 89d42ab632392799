"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one is set for a local session (tests,
    bench); a cluster must name its own, so there it is an error."""
    base = spark.conf.get(SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(SETTING, base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under shared_base."""
    return os.path.join(shared_base(spark), uuid.uuid4().hex)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a plan that loops restarts from a table."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
