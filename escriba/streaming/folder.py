"""Documents as they arrive in a folder: the same corrections and fields, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fields
from ..functions.corrections import correct


def texts(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def extracted(stream: DataFrame) -> DataFrame:
    """doc_id, text and key_values of each document. No state is kept, so nothing grows with the stream."""
    fixed = stream.select("doc_id", correct(F.col("text")).alias("text"))
    return fixed.select("*", *fields.extract_columns(F.col("text"))).withColumn("key_values", fields.as_map()).select("doc_id", "text", "key_values")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Work on what has arrived since the last call and end; files are taken once, whatever fails in between."""
    return extracted(texts(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
