"""Whole documents: read as text, or recognised page by page; one by one or as a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import fields
from ..functions.corrections import correct
from ..functions.naming import is_pdf, language, safe_name, size_mb
from ..functions.regex import strip
from .analysis import TEXT, analyze, route
from .recognition import best_pass, document_of, every_page, pass_confidence, separator, unreadable

# Names of the two ways, and what is said of a file without pages.
TEXT_METHOD, OCR_METHOD = "text_extraction_enhanced", "advanced_ocr"
TEXT_CONFIDENCE = 95.0
NO_PAGES = "PDF no contiene páginas"


def with_fields(documents: DataFrame) -> DataFrame:
    """key_values: the fields found in text."""
    return documents.select("*", *fields.extract_columns(F.col("text"))).withColumn("key_values", fields.as_map()).drop(*fields.PATTERNS)


def _seconds(rows: DataFrame) -> Column:
    """What the pages of a document took together, where that was measured."""
    return (F.sum("seconds") if "seconds" in rows.columns else F.lit(None).cast("double")).alias("seconds")


def process_text(pages: DataFrame) -> DataFrame:
    """Documents from their own text. pages: doc_id, page, text, error (not null: the page could not be read), and seconds where they were measured.

    Blank pages leave nothing, not even a separator; an unreadable one leaves its separator and a note."""
    total = F.col("total_pages")

    def part(p):
        blank = strip(F.coalesce(p["text"], F.lit(""))) == ""
        return F.when(p["error"].isNotNull(), F.concat(separator(p["page"], total), unreadable(p["page"]))).when(blank, F.lit("")).otherwise(F.concat(separator(p["page"], total), p["text"]))

    # corrected before the shuffle, page by page
    corrected = pages.withColumn("text", correct(F.col("text")))
    counted = corrected.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.struct("page", "text", "error"))).alias("pages"), _seconds(corrected))
    text = counted.select("doc_id", "total_pages", "seconds", F.array_join(F.transform("pages", part), "").alias("text"))
    return with_fields(text).select("doc_id", F.lit(True).alias("success"), F.lit(TEXT_METHOD).alias("processing_method"), F.lit(TEXT_CONFIDENCE).alias("confidence"), "total_pages", F.lit(None).cast("long").alias("processed_pages"), F.lit(None).cast("long").alias("low_confidence_pages"), "key_values", "text", "seconds")


def recognise(passes: DataFrame, words: DataFrame) -> DataFrame:
    """Pages from the words of their passes. passes: doc_id, page, pass_no, text, default_text; words: doc_id, page, pass_no, conf. Text is corrected."""
    scored = passes.join(pass_confidence(words, "doc_id", "page", "pass_no"), ["doc_id", "page", "pass_no"], "left").withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
    return best_pass(scored, "doc_id", "page").select("doc_id", "page", correct(F.col("text")).alias("text"), "confidence", F.lit(None).cast("string").alias("error"))


def gathered(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, pages (an array in page order) and seconds from every_page's rows: one shuffle, and each result read once."""
    return pages.groupBy("doc_id").agg(F.max("total_pages").alias("total_pages"), F.array_sort(F.collect_list(F.struct("page", "text", "confidence", "error", "recognised"))).alias("pages"), _seconds(pages))


def scanned_documents(gathered_pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Documents from the arrays of their pages (gathered)."""
    whole = gathered_pages.select("doc_id", "total_pages", "seconds", *document_of(F.col("pages"), F.col("total_pages"), options))
    return with_fields(whole).select("doc_id", F.lit(True).alias("success"), F.lit(OCR_METHOD).alias("processing_method"), "confidence", "total_pages", "processed_pages", "low_confidence_pages", "key_values", "text", "seconds")


def process_scanned(documents: DataFrame, results: DataFrame, options: Options = Options()) -> DataFrame:
    """Documents from recognised pages. documents: doc_id, total_pages (0: a failure); results: doc_id, page, text, confidence, error, and seconds where they were measured."""
    good = scanned_documents(gathered(every_page(documents, results)), options)
    nothing = lambda kind: F.lit(None).cast(kind)
    empty = documents.where("total_pages <= 0").select(
        "doc_id", F.lit(False).alias("success"), nothing("string").alias("processing_method"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("total_pages"), nothing("long").alias("processed_pages"), nothing("long").alias("low_confidence_pages"), nothing("map<string,string>").alias("key_values"), F.lit(NO_PAGES).alias("text"), nothing("double").alias("seconds")
    )
    return good.unionByName(empty)


def process(files: DataFrame, pages: DataFrame, results: DataFrame, options: Options = Options(), normalise_language: bool = True) -> DataFrame:
    """Every file (doc_id, filename, length, force_ocr boolean, language) on its way; an image is a document of one page.

    The two ways are separate branches, so that only documents that need recognition reach it."""
    routed = files.join(analyze(pages, options).select("doc_id", "processing_recommendation", "page_count"), "doc_id", "left").withColumn("way", route(F.col("filename"), F.col("force_ocr"), F.col("processing_recommendation")))
    as_text = process_text(pages.join(routed.where(F.col("way") == TEXT).select("doc_id"), "doc_id", "left_semi"))
    # a rasteriser's count goes before the parser's
    seen = results.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    scans = routed.where(F.col("way") != TEXT).join(seen, "doc_id", "left").select("doc_id", F.when(is_pdf(F.col("filename")), F.coalesce("last_page", "page_count", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("total_pages"))
    done = as_text.unionByName(process_scanned(scans, results, options))
    shown = language(F.col("language")) if normalise_language else F.col("language")
    return files.select("doc_id", safe_name(F.col("filename")).alias("filename"), shown.alias("language"), F.round(size_mb(F.col("length")), 2).alias("file_size_mb")).join(done.withColumnRenamed("seconds", "processing_time"), "doc_id")
