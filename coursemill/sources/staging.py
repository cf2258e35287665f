"""Tables written to the shared folder, where a job reads a result more than once or its plan would grow too large."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the checkpoint folder that was set.

    Where both are unset, a session on one machine (tests) gets a folder of its own; on a cluster, whose executors could
    not read it, that is an error.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/coursemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
