"""What callers get: JSON answers, Markdown reports, sidecars, batch summaries, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import Options
from ..functions.naming import EXTENSIONS, allowed, is_pdf, label, size_mb

# What a batch says of a failed file; the headings and labels of the Markdown report are a fixed format too.
FAILED = "Processing failed"
# Fixed value: the answer when the work as a whole fails.
BROKEN = "Error procesando documento: {why}"


def stamped_name(name: Column, at: Column | None = None) -> Column:
    """The name under which a request's file is kept: the moment, then the safe name."""
    return F.concat(F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss"), F.lit("_"), name)


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def json_response(done: DataFrame, extract_fields: Column | bool = True, with_text: Column | bool = True, seconds: Column | None = None, at: Column | None = None) -> DataFrame:
    """doc_id and response. Absent values are left out: fields unless asked for and found, text unless the format is JSON, and processing_time (seconds,
    to two decimals) and timestamp (at, as ISO 8601) unless they are given or done has them (processing_time, processed_at)."""
    if seconds is None and "processing_time" in done.columns:
        seconds = F.col("processing_time")
    if at is None and "processed_at" in done.columns:
        at = F.col("processed_at")
    time = F.lit(None).cast("double") if seconds is None else F.round(seconds.cast("double"), 2)
    moment = F.lit(None).cast("string") if at is None else _iso(at)
    wanted, texts = (F.lit(x) if isinstance(x, bool) else x for x in (extract_fields, with_text))
    good = F.struct(
        F.lit(True).alias("success"),
        "filename",
        F.col("total_pages").alias("pages_processed"),
        time.alias("processing_time"),
        "processing_method",
        "language",
        "file_size_mb",
        "confidence",
        moment.alias("timestamp"),
        F.when(wanted & (F.size("key_values") > 0), F.col("key_values")).alias("extracted_fields"),
        F.when(texts, F.col("text")).alias("text"),
    )
    bad = F.struct(F.lit(False).alias("success"), F.col("text").alias("error"), time.alias("processing_time"))
    return done.select("doc_id", F.when(F.col("success"), F.to_json(good)).otherwise(F.to_json(bad)).alias("response"))


def markdown_report(done: DataFrame, footer: Column | None = None) -> DataFrame:
    """doc_id and report, with the time taken where done has it. The fields found are listed whatever the request asked for; footer: the last line (none, for comparable output)."""
    took = [F.concat(F.lit("- **Tiempo**: "), F.round("processing_time", 2).cast("string"), F.lit("s"))] if "processing_time" in done.columns else []
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# Procesamiento OCR - "), "filename"),
        F.lit(""),
        F.lit("## Información del Procesamiento"),
        F.concat(F.lit("- **Archivo**: "), "filename"),
        F.concat(F.lit("- **Método**: "), "processing_method"),
        F.concat(F.lit("- **Páginas**: "), F.col("total_pages").cast("string")),
        *took,
        F.concat(F.lit("- **Confianza**: "), F.col("confidence").cast("string"), F.lit("%")),
        F.concat(F.lit("- **Idioma**: "), "language"),
        F.concat(F.lit("- **Tamaño**: "), F.col("file_size_mb").cast("string"), F.lit("MB")),
        F.lit(""),
    )
    lines = F.transform(F.map_entries("key_values"), lambda e: F.concat(F.lit("- **"), label(e["key"]), F.lit("**: "), e["value"]))
    found = F.when(F.size("key_values") > 0, F.concat_ws("\n", F.lit("\n## Campos Extraídos"), F.lit(""), F.array_join(lines, "\n"), F.lit(""))).otherwise(F.lit(""))
    tail = F.concat(F.lit("\n"), F.concat_ws("\n", F.lit("## Contenido Extraído"), F.lit(""), F.lit("```"), F.col("text"), F.lit("```"), F.lit(""), F.lit("---"), *([footer] if footer is not None else [])))
    return done.where("success").select("doc_id", F.concat(head, found, tail).alias("report"))


def processed_footer() -> Column:
    return F.concat(F.lit("*Procesado el "), F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm:ss"), F.lit("*"))


def sidecar(done: DataFrame) -> DataFrame:
    """doc_id and the JSON record kept beside each file's text, for failed files too; with processing_time and timestamp where done has them."""
    took = [F.round("processing_time", 2).alias("processing_time")] if "processing_time" in done.columns else []
    at = [_iso(F.col("processed_at")).alias("timestamp")] if "processed_at" in done.columns else []
    record = F.struct("filename", "success", F.col("total_pages").alias("pages"), *took, F.coalesce("processing_method", F.lit("ocr")).alias("method"), "confidence", F.coalesce("key_values", F.create_map().cast("map<string,string>")).alias("extracted_fields"), *at, "file_size_mb")
    return done.select("doc_id", F.to_json(record).alias("record"))


def batch_summary(done: DataFrame, *keys: str) -> DataFrame:
    """Per batch (keys): total_files, successful, failed, and the files' results in order of doc_id, with their processing_time where done has it; a failed file's reason stays hidden."""
    took = [F.round("processing_time", 2).alias("processing_time")] if "processing_time" in done.columns else []
    result = F.struct("doc_id", "filename", "success", F.col("total_pages").alias("pages"), *took, "confidence", F.when(~F.col("success"), F.lit(FAILED)).alias("error"))
    return done.groupBy(*keys).agg(F.count("*").alias("total_files"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.array_sort(F.collect_list(result)).alias("results"))


def waiting(files: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: n_files, n_accepted (of a known format and size), n_pdf of those, n_refused, and accepted_mb, of files (filename, length) that wait to be worked on."""
    good = allowed(F.col("filename")) & (F.col("length") <= options.max_bytes)
    counts = files.agg(F.count("*").alias("n_files"), F.count_if(good).alias("n_accepted"), F.count_if(good & is_pdf(F.col("filename"))).alias("n_pdf"), F.sum(F.when(good, F.col("length")).otherwise(0)).alias("bytes"))
    return counts.select("n_files", "n_accepted", "n_pdf", (F.col("n_files") - F.col("n_accepted")).alias("n_refused"), F.round(size_mb(F.coalesce("bytes", F.lit(0))), 2).alias("accepted_mb"))


def _facts(recogniser: object | None, options: Options) -> dict[str, Column]:
    formats = F.array(*(F.lit(e) for e in sorted(EXTENSIONS)))
    return {
        "status": F.lit("healthy" if recogniser is not None else "degraded"),
        "version": F.lit(__version__),
        "recogniser_version": F.lit(getattr(recogniser, "version", "unavailable")),
        "dpi": F.lit(options.dpi),
        "language": F.lit(options.language),
        "max_file_size_mb": F.lit(options.max_bytes // (1024 * 1024)),
        "confidence_threshold": F.lit(options.page_confidence),
        "supported_formats": formats,
        "timestamp": F.current_timestamp(),
    }


def health(spark: SparkSession, recogniser: object | None = None, options: Options = Options(), files: DataFrame | None = None) -> DataFrame:
    """One row: healthy if a recogniser is plugged in, else degraded; and what waits to be worked on, where files are given."""
    return (spark.range(1).drop("id") if files is None else waiting(files, options)).withColumns(_facts(recogniser, options))


ENTRY_POINTS = {"health": "state of the engine", "analyze": "how documents would be processed", "process": "documents to text and fields", "batch": "many documents with a summary"}


def describe(spark: SparkSession, files: DataFrame | None = None) -> DataFrame:
    """The engine's entry points and, where files are given, how many of them each would look at."""
    points = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("purpose")) for n, p in ENTRY_POINTS.items())))
    if files is None:
        return spark.range(1).select(points.alias("p")).select("p.*")
    looked_at = F.when(F.col("p.name") == "health", F.col("n_files")).otherwise(F.col("n_accepted")).alias("n_files")
    return waiting(files).withColumn("p", points).select("p.*", looked_at)
