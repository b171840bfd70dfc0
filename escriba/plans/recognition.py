"""From recognised words to pages: confidence of passes, the best pass, fall-backs, counts and confidences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options

# A confidence, and texts that stand for pages without a result (also in the functions below).
FALLBACK_CONFIDENCE = 50.0
MISSING, UNAVAILABLE = "[Página no procesada]", "[Página no disponible]"
UNCONVERTED, CRASHED = "[Error convirtiendo página {page}: {why}]", "[Error procesando página {page}]"
FAILED = "Error procesando página {page}: {why}"
UNRECOGNISED = "Error en OCR: {why}"


def separator(page: Column, pages: Column) -> Column:
    return F.concat(F.lit("\n\n--- Página "), page.cast("string"), F.lit(" de "), pages.cast("string"), F.lit(" ---\n\n"))


def unreadable(page: Column) -> Column:
    return F.concat(F.lit("[Error extrayendo texto de la página "), page.cast("string"), F.lit("]"))


def pass_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """avg_confidence of each pass (keys): the mean of the confidences, cut to whole numbers, that are then above 0; 0 if there is none."""
    whole = F.col("conf").cast("int")
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(whole > 0, whole)), F.lit(0.0)).alias("avg_confidence"))


def best_pass(passes: DataFrame, *keys: str) -> DataFrame:
    """Of each page (keys), the pass with the greatest avg_confidence, the earliest (pass_no) of equals; text and confidence.

    No pass above 0, or a best pass without text: the text of the default pass (default_text) at a fixed confidence."""
    good = F.col("avg_confidence") > 0
    best = passes.groupBy(*keys).agg(F.max_by(F.when(good, F.struct("text", "avg_confidence")), F.when(good, F.struct("avg_confidence", (-F.col("pass_no")).alias("order")))).alias("best"), F.first("default_text", ignorenulls=True).alias("default_text"))
    chosen = F.coalesce(F.col("best.text"), F.lit("")) != ""
    return best.select(*keys, F.when(chosen, F.col("best.text")).otherwise(F.coalesce("default_text", F.lit(""))).alias("text"), F.when(chosen, F.col("best.avg_confidence")).otherwise(F.lit(FALLBACK_CONFIDENCE)).alias("confidence"))


def document_confidence(pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Per doc_id: total_pages, processed_pages (confidence above the threshold, among recognised ones), low_confidence_pages, and their mean confidence to two decimals (0 if there is none)."""
    good = F.col("confidence") > options.page_confidence
    if "recognised" in pages.columns:
        good = good & F.col("recognised")
    out = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if(good).alias("processed_pages"), F.sum(F.when(good, F.col("confidence"))).alias("total"))
    return out.select("doc_id", "total_pages", "processed_pages", (F.col("total_pages") - F.col("processed_pages")).alias("low_confidence_pages"), F.round(F.coalesce("total", F.lit(0.0)) / F.greatest(F.lit(1), F.col("processed_pages")), 2).alias("confidence"))


def every_page(documents: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each page 1 to total_pages of documents (doc_id, total_pages), with its result (text, confidence, error, and seconds where results have them) or, where there is none, the text MISSING at confidence 0."""
    pages = documents.select("doc_id", "total_pages", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page")).where("total_pages > 0")
    timed = ["seconds"] if "seconds" in results.columns else []
    joined = pages.join(results.select("doc_id", "page", "text", "confidence", "error", *timed, F.lit(True).alias("recognised")), ["doc_id", "page"], "left")
    return joined.select("doc_id", "total_pages", "page", F.when(F.col("recognised"), F.coalesce("text", F.lit(""))).otherwise(F.lit(MISSING)).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "error", F.coalesce("recognised", F.lit(False)).alias("recognised"), *timed)


def page_part(page: Column, total: Column, text: Column, error: Column) -> Column:
    """What a page adds to its document: separator, text, and a note of its error."""
    noted = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("\n[ERROR: "), error, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(separator(page, total), text, noted)


def document_of(pages: Column, total: Column, options: Options = Options()) -> list[Column]:
    """text, processed_pages, low_confidence_pages and confidence (as in document_confidence) of a document from the array of its pages (page, text, confidence, error, recognised) in order."""
    good = F.filter(pages, lambda p: p["recognised"] & (p["confidence"] > options.page_confidence))
    n = F.size(good).cast("long")
    mean = F.aggregate(good, F.lit(0.0), lambda a, p: a + p["confidence"]) / F.greatest(F.lit(1), n)
    text = F.array_join(F.transform(pages, lambda p: page_part(p["page"], total, p["text"], p["error"])), "")
    return [text.alias("text"), n.alias("processed_pages"), (total - n).alias("low_confidence_pages"), F.round(mean, 2).alias("confidence")]


def assemble(pages: DataFrame) -> DataFrame:
    """doc_id and text: separators, page texts and error notes in page order. pages: doc_id, total_pages, page, text, error."""
    part = page_part(F.col("page"), F.col("total_pages"), F.col("text"), F.col("error"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))), lambda p: p["part"]), "")
    return pages.groupBy("doc_id").agg(joined.alias("text"))
