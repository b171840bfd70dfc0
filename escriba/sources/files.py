"""Files as rows: uploads, images, page texts of PDF files."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import allowed
from .pdf import page_texts

PAGES = "doc_id long, page int, text string, image_count int, error string, seconds double"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (a hash of the path), path, filename, length, content of every file in the folder. Columns that aren't read aren't loaded."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.substring_index("path", "/", -1).alias("filename"), "length", "content")


def accepted(files: DataFrame) -> DataFrame:
    return files.where(allowed(F.col("filename")))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """img (a hash of the path), height, width and BGR pixels (bytes) of every readable image; gray ones and ones with an alpha channel become BGR."""
    read = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            pixels = []
            for n, h, w, raw in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                img = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                img = np.repeat(img, 3, axis=2) if n == 1 else img[:, :, :3]
                pixels.append(np.ascontiguousarray(img).tobytes())
            yield pa.record_batch({"img": batch.column(0), "height": batch.column(2), "width": batch.column(3), "pixels": pa.array(pixels, pa.binary())})

    return read.select(F.xxhash64("origin").alias("img"), "nChannels", "height", "width", "data").mapInArrow(run, "img long, height int, width int, pixels binary")


def pdf_pages(files: DataFrame, max_pages: int | None = None) -> DataFrame:
    """A row for each page of PDF files (doc_id, content): its text, its images, or why it could not be read, and its share of the seconds that parsing took. A file that is no PDF gives no row.

    max_pages limits what is parsed where only the first pages are wanted (routing): a filter on page would not reach the parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                began = time.monotonic()
                rows = page_texts(batch.column(1)[i].as_py() or b"", max_pages)
                if rows:
                    share = (time.monotonic() - began) / len(rows)
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()),
                            "page": pa.array(range(1, len(rows) + 1), pa.int32()),
                            "text": pa.array([r[0] for r in rows], pa.string()),
                            "image_count": pa.array([r[1] for r in rows], pa.int32()),
                            "error": pa.array([r[2] for r in rows], pa.string()),
                            "seconds": pa.array([share] * len(rows), pa.float64()),
                        }
                    )

    return files.select("doc_id", "content").mapInArrow(run, PAGES)
