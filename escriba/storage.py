"""Tables kept in the folder that the driver and all executors share: written once, read by every later step, and not lost with an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset and all runs on one machine (tests), a folder of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "escriba-shared")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, kind: str = "kept") -> DataFrame:
    """The same rows, as Parquet files in the shared folder: readers take the columns they need, and nothing is computed twice. The folder stays."""
    where = new_folder(df.sparkSession, kind)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
