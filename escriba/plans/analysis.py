"""Routing: is a document's own text good enough, or must its pages be recognised?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.naming import is_pdf, size_mb
from ..functions.regex import collapse, strip

TEXT, HYBRID, OCR = "text_extraction", "hybrid", "ocr"


def recommendation(length: Column, density: Column, has_images: Column, options: Options) -> Column:
    return F.when((length >= options.text_threshold) & ~has_images, TEXT).when((length >= 200) & (density > 100), HYBRID).otherwise(OCR)


def analyze(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Per doc_id of pages (doc_id, page from 1, text, image_count, and page_count where only the first pages are there): flags, counts, density, recommendation, confidence and a sample of the text.

    Only the first pages' texts go through the shuffle (one, by doc_id, after partial aggregation); all pages are counted.
    A page without text still adds its space; density is of the first pages' text over all pages."""
    first = F.col("page") <= options.pages_to_route
    count = F.max("page_count").cast("long") if "page_count" in pages.columns else F.count("*")
    text = strip(collapse(F.coalesce("text", F.lit(""))))
    whole = F.array_join(F.transform(F.array_sort("parts"), lambda p: F.concat(p["text"], F.lit(" "))), "")
    out = (
        pages.groupBy("doc_id")
        .agg(count.alias("page_count"), F.coalesce(F.sum(F.when(first, F.col("image_count"))), F.lit(0)).alias("images"), F.collect_list(F.when(first, F.struct("page", text.alias("text")))).alias("parts"))
        .withColumn("whole", whole)
        .withColumn("text_length", F.length(strip(F.col("whole"))))
        .withColumn("text_density", F.col("text_length") / F.greatest(F.lit(1), F.col("page_count")))
        .withColumn("has_images", F.col("images") > 0)
        .withColumn("processing_recommendation", recommendation(F.col("text_length"), F.col("text_density"), F.col("has_images"), options))
    )
    confidence = F.when(F.col("processing_recommendation") == TEXT, 0.9).when(F.col("processing_recommendation") == HYBRID, 0.7).otherwise(0.8)
    return out.select("doc_id", (F.col("text_length") > 50).alias("has_text"), "has_images", "text_length", "page_count", "text_density", "processing_recommendation", confidence.alias("confidence"), strip(F.substring("whole", 1, 500)).alias("sample_text"))


def analyze_files(files: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Per file (doc_id, filename, length): the analysis of a PDF, the fixed answer for an image, or OCR without confidence for a PDF that gave no page."""
    known = analyze(pages, options)
    pdf, read = is_pdf(F.col("filename")), F.col("page_count").isNotNull()
    joined = files.select("doc_id", "filename", "length").join(known, "doc_id", "left")
    value = lambda name, image, failed: F.when(~pdf, F.lit(image)).when(read, F.col(name)).otherwise(F.lit(failed)).alias(name)
    return joined.select(
        "doc_id",
        "filename",
        value("has_text", False, False),
        value("has_images", True, False),
        value("text_length", None, 0),
        value("page_count", None, 0),
        value("text_density", None, 0.0),
        value("processing_recommendation", OCR, OCR),
        value("confidence", 0.8, 0.0),
        value("sample_text", None, ""),
        size_mb(F.col("length")).alias("file_size_mb"),
    )


def route(name: Column, force_ocr: Column, recommended: Column) -> Column:
    """The way a document goes. Only TEXT reads its text; HYBRID goes the way of OCR."""
    return F.when(is_pdf(name) & ~force_ocr, F.coalesce(recommended, F.lit(OCR))).otherwise(F.lit(OCR))
