"""Results as files: texts, JSON answers, sidecars, and a bundle of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import stem
from ..plans.reports import batch_summary, sidecar
from .named_files import ARCHIVES, Archives, NamedFiles
from .named_files import NAME as NAMED_FILES


#: Documents for which a file each is written.
MOST_FILES = 10_000


def write_texts(done: DataFrame, folder: str) -> None:
    """doc_id and text of every document, as lines of JSON: as many files as there are partitions, whatever the number of documents."""
    done.select("doc_id", "text").write.json(folder)


def write_text_files(done: DataFrame, folder: str) -> None:
    """A text file for each document of a batch, in a folder doc_id=... (UTF-8, the text as it is). More than MOST_FILES documents are refused."""
    if done.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} documents: use write_texts")
    done.select("doc_id", "text").write.partitionBy("doc_id").option("lineSep", "\n").text(folder)


def named(done: DataFrame, *within: str) -> DataFrame:
    """done with base: the file name without its extension, followed by _ and doc_id where several documents (of one batch: within) share it."""
    based = done.withColumn("base", stem(F.col("filename")))
    shared = based.groupBy(*within, "base").agg(F.count("*").alias("n")).where("n > 1").select(*within, "base", F.lit(True).alias("shared"))
    joined = based.join(shared, [*within, "base"], "left")
    return joined.withColumn("base", F.when(F.col("shared") | (F.col("base") == ""), F.concat_ws("_", "base", F.col("doc_id").cast("string"))).otherwise(F.col("base"))).drop("shared")


def write_documents(done: DataFrame, folder: str) -> None:
    """Two files for each document, written where the documents are: NAME.txt with its text (of good ones), and NAME.json with its record. All appear together, or none."""
    done.sparkSession.dataSource.register(NamedFiles)
    rows = named(done).join(sidecar(done), "doc_id")
    kinds = F.array(F.struct(F.lit(".json").alias("ending"), F.col("record").alias("content")), F.when(F.col("success"), F.struct(F.lit(".txt").alias("ending"), F.coalesce("text", F.lit("")).alias("content"))))
    files = rows.select("base", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("file"))
    files.select(F.concat("base", "file.ending").alias("name"), F.col("file.content").alias("content")).write.format(NAMED_FILES).mode("append").save(folder)


def write_records(done: DataFrame, folder: str) -> None:
    """The sidecars of all files, of failed ones too, as lines of JSON."""
    sidecar(done).select(F.col("record").alias("value")).write.text(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What write_texts wrote."""
    return spark.read.schema("doc_id long, text string").json(folder)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """What write_text_files wrote."""
    return spark.read.option("wholetext", True).text(folder).select("doc_id", F.regexp_replace("value", r"\n\z", "").alias("text"))


def write_bundles(done: DataFrame, folder: str, language: str = "spa", force_ocr: bool = False, batches: DataFrame | None = None) -> None:
    """A ZIP file for each batch_id, lote_procesado_BATCH.zip: NAME.txt of each good file, NAME.json of every file, and resumen_lote.json. A batch is written by one task, a file at a time
    as its rows come; batches are written beside each other, and appear together or not at all. batches (batch_id) may name batches without a file, too: they have a summary only."""
    done.sparkSession.dataSource.register(Archives)
    rows = named(done, "batch_id").join(sidecar(done), "doc_id")
    kinds = F.array(F.struct(F.lit(".json").alias("ending"), F.col("record").alias("content")), F.when(F.col("success"), F.struct(F.lit(".txt").alias("ending"), F.coalesce("text", F.lit("")).alias("content"))))
    files = rows.select("batch_id", "base", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("file")).select("batch_id", F.concat("base", "file.ending").alias("name"), F.col("file.content").alias("content"))
    summary = batch_summary(done, "batch_id").withColumn("results", F.transform("results", lambda r: r.dropFields("doc_id")))
    if batches is not None:
        none = F.array().cast(summary.schema["results"].dataType)
        summary = batches.select("batch_id").join(summary, "batch_id", "left").select("batch_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "successful", "failed")), F.coalesce("results", none).alias("results"))
    about = F.struct(F.col("batch_id").cast("string").alias("batch_id"), "total_files", "successful", "failed", F.lit(language).alias("language"), F.lit(force_ocr).alias("force_ocr"), "results")
    whole = files.unionByName(summary.select("batch_id", F.lit("resumen_lote.json").alias("name"), F.to_json(about, {"ignoreNullFields": "false", "pretty": "true"}).alias("content")))
    placed = whole.repartition("batch_id").sortWithinPartitions("batch_id", "name")
    placed.select(F.concat(F.lit("lote_procesado_"), F.col("batch_id").cast("string"), F.lit(".zip")).alias("archive"), "name", "content").write.format(ARCHIVES).mode("append").save(folder)


def bundle(done: DataFrame, folder: str, batch_id: str, language: str = "spa", force_ocr: bool = False) -> str:
    """All of done as one batch; the name of its file in the folder."""
    write_bundles(done.withColumn("batch_id", F.lit(batch_id)), folder, language, force_ocr, done.sparkSession.createDataFrame([(batch_id,)], "batch_id string"))
    return f"lote_procesado_{batch_id}.zip"
