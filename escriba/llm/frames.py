"""What the operators share on the DataFrame side: inputs, checkpoints, measured sizes."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes (as counted, not as guessed) are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string only, whatever other columns there are; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The session names it in spark.checkpoint.dir; only where that is unset (tests on one machine), a folder of this machine is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "escriba-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: later stages don't recompute them, and a lost executor loses none of them."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """df, checkpointed, read back in no more partitions than its counted rows need: a small table dealt over very many partitions would make each later shuffle write as many files."""
    df = cut(df)
    return df.coalesce(max(1, -(-df.count() // rows)))


def is_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df (checkpointed) has rows for at most limit bytes; counts limit // row_bytes + 1 rows at most."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in limit bytes; else df itself, and the join shuffles."""
    return F.broadcast(df) if is_small(df, row_bytes, limit) else df


def broadcast_measured(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (checkpointed) with a broadcast hint if size, the bytes of a row, sums up to limit at most; else df itself."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def fresh(names: list[str], like: str) -> str:
    """A column name that isn't among names, whatever their case."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't in gone; rows without a doc_id stay."""
    name = fresh(docs.columns, "gone")
    ids = cut(gone.where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(maybe_broadcast(ids, 16), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over the Arrow batches of df, as they come; no state between batches, so a lost task is simply run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
