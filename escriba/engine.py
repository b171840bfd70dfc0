"""Entry points: analyze, process, batch, health. Files come as rows (sources.files.uploads), answers leave as rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Options
from .functions import naming
from .functions.corrections import correct
from .operators.attempts import recognise_surely
from .operators.engines import Rasteriser, Recogniser
from .plans import analysis, drivers, reports
from .sources.files import accepted, pdf_pages, uploads
from .sources.page_source import folder_pages
from .storage import keep


def analyze(files: DataFrame, options: Options = Options()) -> DataFrame:
    """How each accepted file would be processed. Only as many pages are parsed as routing looks at."""
    good = accepted(files)
    return analysis.analyze_files(good, pdf_pages(good, options.pages_to_route), options)


def analyze_folder(spark: SparkSession, folder: str, options: Options = Options()) -> DataFrame:
    """The same for the files of a folder, read by the page source: of each file only the pages that routing looks at are parsed, where they lie, and no file's content is a row."""
    good = accepted(uploads(spark, folder).select("doc_id", "filename", "length"))
    pages = folder_pages(spark, folder, ("page", "page_count", "text", "image_count")).where(F.col("page") <= options.pages_to_route)
    return analysis.analyze_files(good, pages, options)


def _recognised(files: DataFrame, rasteriser: Rasteriser | None, recogniser: Recogniser | None, language: str, options: Options) -> DataFrame:
    """A row for each page, its text corrected unless it is a note."""
    if rasteriser is None or recogniser is None:
        return files.sparkSession.createDataFrame([], "doc_id long, page int, text string, confidence double, error string, seconds double")
    found = recognise_surely(files, rasteriser, recogniser, language, options)
    return found.select("doc_id", "page", F.when(F.col("as_is"), F.col("text")).otherwise(correct(F.col("text"))).alias("text"), "confidence", "error", "seconds")


def process(files: DataFrame, force_ocr: bool = False, language: str = "spa", rasteriser: Rasteriser | None = None, recogniser: Recogniser | None = None, options: Options = Options()) -> DataFrame:
    """Text, fields and figures of each accepted file, with processing_time (seconds that its pages took in tasks) and processed_at.

    A file is parsed once and a page recognised once: both are kept in the shared folder before anything is made of them. Only files whose own text isn't good enough are rasterised
    and recognised; without engines their pages are missing."""
    good = accepted(files).withColumns({"force_ocr": F.lit(force_ocr), "language": F.lit(language)})
    pages = keep(pdf_pages(good), "pages")
    way = good.select("doc_id", "filename", "force_ocr").join(analysis.analyze(pages, options).select("doc_id", "processing_recommendation"), "doc_id", "left")
    scans = way.where(analysis.route(F.col("filename"), F.col("force_ocr"), F.col("processing_recommendation")) != analysis.TEXT).select("doc_id")
    results = keep(_recognised(good.join(scans, "doc_id", "left_semi"), rasteriser, recogniser, language, options), "recognised")
    return drivers.process(good, pages, results, options).withColumn("processed_at", F.current_timestamp())


def respond(requests: DataFrame, fmt: str = "json", extract_fields: bool = True, **how) -> DataFrame:
    """Per request (doc_id, filename, length, content; has_part boolean where a file may be missing) its status, response, and the name under which its file is kept.

    Refused requests say why (400, or 413 for too large a file) and are not worked on. Good ones are processed (how: as for process): 200 with the answer, Markdown for "md" or the bare text for
    "txt", or 500 for a document that gave nothing. If the work as a whole fails, every good request is answered with that (500), and none is left without an answer."""
    part = F.col("has_part") if "has_part" in requests.columns else F.lit(True)
    checked = requests.withColumn("refusal", naming.request_error(part, F.col("filename"), F.col("length")))
    stored = reports.stamped_name(naming.safe_name(F.col("filename"))).alias("stored_name")
    refused = checked.where("refusal is not null").select("doc_id", naming.request_status(F.col("length"), F.col("refusal")).alias("status"), F.to_json(F.struct(F.col("refusal").alias("error"))).alias("response"), F.lit(None).cast("string").alias("stored_name"))
    good = checked.where("refusal is null").drop("refusal")
    names = good.select("doc_id", stored)
    began = time.monotonic()
    try:
        done = keep(process(good, **how), "answers")
        answer = reports.json_response(done, extract_fields)
        if fmt != "json":
            shown = reports.markdown_report(done, reports.processed_footer()) if fmt == "md" else done.where("success").select("doc_id", F.col("text").alias("report"))
            answer = answer.join(shown, "doc_id", "left").select("doc_id", F.coalesce("report", "response").alias("response"))
        answers = done.select("doc_id", F.when(F.col("success"), 200).otherwise(500).alias("status")).join(answer, "doc_id")
    except Exception as e:
        failure = F.struct(F.lit(False).alias("success"), F.lit(reports.BROKEN.format(why=str(e).split("\n")[0])).alias("error"), F.lit(round(time.monotonic() - began, 2)).alias("processing_time"))
        answers = good.select("doc_id", F.lit(500).alias("status"), F.to_json(failure).alias("response"))
    return answers.join(names, "doc_id").select("doc_id", "status", "response", "stored_name").unionByName(refused)


def batch(files: DataFrame, batch_id: str, force_ocr: bool = False, language: str = "spa", options: Options = Options(), **engines) -> DataFrame:
    """One row: counts and results of all accepted files, and how they were worked on; other files are skipped and not counted."""
    done = process(files, force_ocr=force_ocr, language=language, options=options, **engines)
    summary = reports.batch_summary(done.withColumn("batch_id", F.lit(batch_id)), "batch_id")
    system = F.struct(F.lit(__version__).alias("version"), F.lit(files.sparkSession.sparkContext.defaultParallelism).alias("workers"), F.lit(options.dpi).alias("dpi"))
    return summary.withColumns({"language": naming.language(F.lit(language)), "force_ocr": F.lit(force_ocr), "timestamp": F.current_timestamp(), "system_info": system})


def health(spark: SparkSession, recogniser: Recogniser | None = None) -> DataFrame:
    return reports.health(spark, recogniser)
