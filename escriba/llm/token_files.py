"""Token-ID files: documents as blocks of range-coded ids, in ascending doc_id order.

Documents are dealt by ranges of doc_id and sorted within each; a task tokenises its range, appends the end id to each document,
and cuts the stream into blocks of whole documents (BLOCK_IDS ids, or one longer document). A block is coded on its own (see
range_coder) and written as a row of a Parquet file in a folder that all executors share; Spark's commit protocol keeps files of
lost or repeated tasks out. A block knows its range (part), its place in it, its documents with their lengths, and how many
ids of the range stand before it; the ids before a range are a sum over ranges, which the reader makes from the files'
metadata columns (one number for each range).

Defined results: null and empty texts are documents of the end id alone; rows repeated under one doc_id are documents each
for itself, ordered by text; rows without a doc_id stand before all others, in the same way. An empty table writes no block; other columns are neither read nor written. A very
long text is a block by itself where it has more than BLOCK_IDS ids; a task holds one block's ids at a time. All rows of one doc_id are one range, so ids that are no ids make
one task long, but not large.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, range_coder, text
from .word_bpe import load, worker_encoder

BLOCK_IDS = 1 << 21
END_ID = 2
BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts to the folder path."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(shared.value)
        part = TaskContext.get().partitionId()
        doc_ids: list[int] = []
        lengths: list[int] = []
        streams: list[np.ndarray] = []
        size, before, number = 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(streams)
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int32())),
                    "payload": pa.array([range_coder.encode(ids)], pa.binary()),
                }
            )

        for batch in batches:
            for rows in text.slices(batch):
                ids, n = encoder.encode(rows.column(1))
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                own = rows.column(0).to_pylist()
                done = 0
                while done < len(own):
                    # as many documents as the block has room for, one at least in an empty block
                    reach = int(ends[done - 1]) if done else 0
                    to = int(np.searchsorted(ends, reach + block_ids - size, "right"))
                    if to <= done and not size:
                        to = done + 1
                    if to > done:
                        streams.append(ids[reach : ends[to - 1]])
                        doc_ids += own[done:to]
                        lengths += n[done:to].tolist()
                        size += len(streams[-1])
                        done = to
                    if done < len(own):
                        yield block()
                        before, number = before + size, number + 1
                        doc_ids, lengths, streams, size = [], [], [], 0
        if streams:
            yield block()

    frames.doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids, in files written by write()."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each range
    offsets, total = {}, 0
    for r in parts:
        offsets[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = range_coder.decode(row.column(6)[0].as_py())
                n = row.column(5)[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.append(0, np.cumsum(n))
                start = first[:-1] + row.column(2)[0].as_py() + shared.value[row.column(0)[0].as_py()]
                yield pa.record_batch({"doc_id": row.column(4)[0].values, "start": start, "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int32)))})

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            first = lists.offsets.to_numpy(zero_copy_only=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": np.diff(first).astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    return read(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def remove(spark: SparkSession, path: str) -> None:
    """Delete the files of write(), wherever Spark keeps them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write files to the shared folder and describe what is read from them. The result is read from the files whenever it is used, so they stay
    (in token-files-*, beside the checkpoints) until the owner of that folder clears it, or calls remove()."""
    spark = docs.sparkSession
    path = f"{frames.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return digests(spark, path)
