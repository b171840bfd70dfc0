"""Token counts with the whole-token shortcut.

Offline (once, on the driver) the vocabulary's strings that encode alone as one token are proven by the library's own
merges. Pre-tokens found among them count one without merging; only the rest is merged, each distinct one once in a worker. One
pass over the documents, no shuffle.

Defined results: null and empty texts have 0 bytes and 0 tokens; special tokens' strings within a text count as the library
counts them by default; repeated rows, and rows without a doc_id, are answered each for itself. An empty table has no rows; other columns are neither read nor
returned. A very long text is a slice by itself, worked on whole in memory of some tens of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text
from .word_bpe import load, prove_whole, worker_encoder

LIMIT = 2048


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_direct (tokens counted by the shortcut)."""
    spec = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((spec, prove_whole(spec)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(*shared.value)
        for batch in batches:
            for part in text.slices(batch, most=1 << 20):
                n, direct = encoder.counts(part.column(1))
                _, offsets = text.utf8(part.column(1))
                yield pa.record_batch({"doc_id": part.column(0), "n_bytes": np.diff(offsets), "n_tokens": n.astype(np.int64), "n_direct": direct.astype(np.int64)})

    return frames.doc_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_direct long")


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    return count_tokens(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
