"""Every registered query of the document engine, with the SQL that it is held against (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Options
from .functions import fields, naming
from .functions.corrections import correct, correct_tokens, rewrite, sql_correct, sql_rewrite, sql_tokens
from .functions.regex import sql_collapse, sql_strip
from .operators import image, points, rasters
from .plans import analysis, drivers, fixtures, recognition, reports
from .plans.fixtures import duckdb, table
from .storage import new_folder
from .streaming import arriving

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


LEGAL = duckdb(fixtures.LEGAL_DOCS)
CORRECTED = f"(select doc_id, {sql_correct('text')} as text from {LEGAL} legal)"


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, fixtures.LEGAL_DOCS)


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal(spark, sf_dir).select("doc_id", correct(F.col("text")).alias("text"))


# --- text rules

_add("correct_tokens", lambda s, d: _legal(s, d).select("doc_id", correct_tokens(F.col("text")).alias("text")), f"select doc_id, {sql_tokens('text')} as text from {LEGAL} l")
for _name, _rules in {
    "rewrite_case_numbers": ("R1", "R2", "R3", "R4"),
    "rewrite_resolution": ("R5", "R6", "R7", "R8"),
    "rewrite_dates": ("R9", "R10"),
    "rewrite_plates": ("R11", "R12"),
    "rewrite_articles": ("R13", "R14"),
    "cleanup_whitespace": ("R15", "R16", "N1", "N2", "N3"),
}.items():
    _add(_name, lambda s, d, r=_rules: _legal(s, d).select("doc_id", rewrite(F.col("text"), *r).alias("text")), f"select doc_id, {sql_rewrite('text', *_rules)} as text from {LEGAL} l")
_add("rewrite_plates_documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", rewrite(F.col("text"), "R11", "R12").alias("text")), f"select doc_id, {sql_rewrite('text', 'R11', 'R12')} as text from documents")
_add("correct_full", _corrected, f"select * from {CORRECTED} c")

# --- fields

for _field in fields.PATTERNS:
    _add(f"extract_{_field}", lambda s, d, f=_field: _corrected(s, d).select("doc_id", fields.extract(F.col("text"), f).alias("value")), f"select doc_id, {fields.sql_extract('text', _field)} as value from {CORRECTED} c")
for _field in ("carpeta_fiscal", "fiscal"):  # on the text as it came; correction joins the lines that end the second
    _add(f"extract_raw_{_field}", lambda s, d, f=_field: _legal(s, d).select("doc_id", fields.extract(F.col("text"), f).alias("value")), f"select doc_id, {fields.sql_extract('text', _field)} as value from {LEGAL} l")
WIDE = f"(select doc_id, {', '.join(f'{fields.sql_extract("text", f)} as {f}' for f in fields.PATTERNS)} from {CORRECTED} c)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).select("doc_id", *fields.extract_columns(F.col("text")))


LONG = "(" + " union all ".join(f"select doc_id, '{f}' as field, {f} as value from wide where {f} is not null" for f in fields.PATTERNS) + ")"
_add("extract_fields_wide", _wide, f"select * from {WIDE} w")
_add("extract_fields_map", lambda s, d: _wide(s, d).select("doc_id", F.explode(fields.as_map()).alias("field", "value")), f"with wide as {WIDE} select * from {LONG} l")
_add("field_coverage", lambda s, d: _wide(s, d).select(F.explode(fields.as_map()).alias("field", "value")).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct")), f"with wide as {WIDE} select field, count(*) as n, count(distinct value) as n_distinct from {LONG} l group by field")
_add(
    "long_dates",
    lambda s, d: _corrected(s, d).select("doc_id", fields.long_date(F.col("text")).alias("fecha_completa")),
    f"select doc_id, case when regexp_matches(text, '(?i)[0-9]{{1,2}} +de +[\\p{{L}}\\p{{N}}_]+ +del? +[0-9]{{4}}') then regexp_extract(text, '(?i)([0-9]{{1,2}}) +de', 1) || ' de ' || lower(regexp_extract(text, '(?i)[0-9]{{1,2}} +de +([\\p{{L}}\\p{{N}}_]+) +del? +[0-9]{{4}}', 1)) || ' del ' || regexp_extract(text, '(?i)[0-9]{{1,2}} +de +[\\p{{L}}\\p{{N}}_]+ +del? +([0-9]{{4}})', 1) end as fecha_completa from {CORRECTED} c",
)

# --- names and requests

UPLOADS, AND_DAMAGED = duckdb(fixtures.UPLOADS), duckdb(fixtures.AND_DAMAGED)
EXT = "case when contains(filename, '.') then lower(regexp_extract(filename, '\\.([^.]*)$', 1)) end"
OK = f"coalesce({EXT} in ({', '.join(repr(e) for e in naming.EXTENSIONS)}), false)"
SAFE = "regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(translate(regexp_replace(translate(filename, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '[^\\x00-\\x7F]', '', 'g'), '/\\', '  '), '\\s+'), lambda w: w <> ''), '_'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g')"
STEM = "case when regexp_matches(filename, '[^.]\\.[^.]*$') then regexp_replace(filename, '\\.[^.]*$', '') else filename end"
LANG = "case when language in ('spa', 'eng', 'spa+eng') then language else 'spa' end"
_add(
    "file_names",
    lambda s, d: table(s, d, fixtures.UPLOADS).select("doc_id", naming.allowed(F.col("filename")).alias("allowed"), naming.is_pdf(F.col("filename")).alias("is_pdf"), naming.safe_name(F.col("filename")).alias("safe_name"), naming.stem(F.col("filename")).alias("stem"), naming.size_mb(F.col("length")).alias("size_mb"), naming.language(F.col("language")).alias("language")),
    f"select doc_id, {OK} as allowed, lower(filename) like '%.pdf' as is_pdf, {SAFE} as safe_name, {STEM} as stem, length / 1048576 as size_mb, {LANG} as language from {UPLOADS} u",
)
_add(
    "request_errors",
    lambda s, d: table(s, d, fixtures.UPLOADS).select("doc_id", naming.request_error(F.col("doc_id") % 17 != 0, F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("filename")), F.col("length")).alias("error")),
    f"select doc_id, case when doc_id % 17 = 0 then '{naming.NO_PART}' when doc_id % 13 = 0 then '{naming.NO_NAME}' when not {OK} then '{naming.BAD_FORMAT}' when length > {naming.MAX_BYTES} then 'Archivo muy grande: ' || format('{{:.1f}}', length / 1048576) || 'MB' end as error from {UPLOADS} u",
)

# --- routing


def _analysis_sql(pages: str) -> str:
    clean = sql_strip(sql_collapse("text"))
    whole = f"(select doc_id, count(*) as page_count, coalesce(sum(case when page <= 3 then image_count end), 0) as images, coalesce(string_agg(case when page <= 3 then {clean} || ' ' end, '' order by page), '') as whole from {pages} p group by doc_id)"
    sized = f"(select *, length({sql_strip('whole')}) as text_length, images > 0 as has_images from {whole} w)"
    rated = f"(select *, text_length / greatest(1, page_count) as text_density from {sized} s)"
    routed = f"(select *, case when text_length >= 800 and not has_images then 'text_extraction' when text_length >= 200 and text_density > 100 then 'hybrid' else 'ocr' end as processing_recommendation from {rated} r)"
    return f"(select doc_id, text_length > 50 as has_text, has_images, cast(text_length as int) as text_length, page_count, cast(text_density as double) as text_density, processing_recommendation, case processing_recommendation when 'text_extraction' then 0.9::double when 'hybrid' then 0.7::double else 0.8::double end as confidence, {sql_strip('left(whole, 500)')} as sample_text from {routed} x)"


SINGLE = _analysis_sql(duckdb(fixtures.SINGLE_DOCS))
_add("analyze_pages", lambda s, d: analysis.analyze(table(s, d, fixtures.DOC_PAGES)), f"select * from {_analysis_sql(duckdb(fixtures.DOC_PAGES))} a")
_add("analyze_single", lambda s, d: analysis.analyze(table(s, d, fixtures.SINGLE_DOCS)), f"select * from {SINGLE} a")
_add(
    "analyze_files",
    lambda s, d: analysis.analyze_files(table(s, d, fixtures.AND_DAMAGED), table(s, d, fixtures.SINGLE_DOCS)).na.fill(-1, ["text_length", "page_count", "text_density"]),
    f"""select u.doc_id, filename, case when not pdf then false else coalesce(has_text, false) end as has_text, case when not pdf then true else coalesce(has_images, false) end as has_images,
    case when pdf then coalesce(text_length, 0) else -1 end as text_length, case when pdf then coalesce(page_count, 0) else -1 end as page_count, case when pdf then coalesce(text_density, 0) else -1 end as text_density,
    case when pdf then coalesce(processing_recommendation, 'ocr') else 'ocr' end as processing_recommendation, case when pdf then coalesce(confidence, 0) else 0.8 end as confidence, case when pdf then coalesce(sample_text, '') end as sample_text, u.length / 1048576 as file_size_mb
    from (select *, lower(filename) like '%.pdf' as pdf from {AND_DAMAGED} x) u left join {SINGLE} a on a.doc_id = u.doc_id""",
)
ROUTE_SQL = f"(select u.doc_id, case when lower(filename) like '%.pdf' and not force_ocr then processing_recommendation else 'ocr' end as way from {UPLOADS} u join {SINGLE} a on a.doc_id = u.doc_id)"


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = analysis.analyze(table(spark, sf_dir, fixtures.SINGLE_DOCS)).select("doc_id", "processing_recommendation")
    return table(spark, sf_dir, fixtures.UPLOADS).join(known, "doc_id").select("doc_id", analysis.route(F.col("filename"), F.col("force_ocr"), F.col("processing_recommendation")).alias("way"))


_add("route", _routed, f"select * from {ROUTE_SQL} r")
_add("routing_summary", lambda s, d: _routed(s, d).groupBy("way").agg(F.count("*").alias("n")), f"select way, count(*) as n from {ROUTE_SQL} r group by way")

# --- recognition

WORDS, PASSES, FILES = duckdb(fixtures.OCR_WORDS), duckdb(fixtures.OCR_PASSES), duckdb(fixtures.OCR_FILES)
PASS_SQL = f"(select doc_id, page, pass_no, coalesce(avg(case when trunc(conf) > 0 then trunc(conf) end), 0) as avg_confidence from {WORDS} w group by all)"
BEST_SQL = f"""(select p.doc_id, p.page, case when coalesce(text, '') <> '' then text else default_text end as text, case when coalesce(text, '') <> '' then avg_confidence else 50 end as confidence
 from (select doc_id, page, min(default_text) as default_text from {PASSES} x group by all) p left join (select a.doc_id, a.page, a.text, b.avg_confidence from {PASSES} a join {PASS_SQL} b using (doc_id, page, pass_no) where avg_confidence > 0 qualify row_number() over (partition by doc_id, page order by avg_confidence desc, pass_no) = 1) c using (doc_id, page))"""
RESULT_SQL = f"(select doc_id, page, {sql_correct('text')} as text, cast(confidence as double) as confidence, case when page % 4 = 0 then 'ilegible' end as error from {BEST_SQL} b)"
EVERY_SQL = f"(select f.doc_id, total_pages, f.page, coalesce(r.text, '{recognition.MISSING}') as text, coalesce(r.confidence, 0) as confidence, error, r.doc_id is not null as recognised from (select doc_id, total_pages, cast(unnest(range(1, total_pages + 1)) as int) as page from {FILES} x) f left join {RESULT_SQL} r on r.doc_id = f.doc_id and r.page = f.page)"
COUNT_SQL = f"(select doc_id, count(*) as total_pages, cast(count_if(confidence > 60 and recognised) as bigint) as processed_pages, cast(count(*) - count_if(confidence > 60 and recognised) as bigint) as low_confidence_pages, round(coalesce(sum(case when confidence > 60 and recognised then confidence end), 0) / greatest(1, count_if(confidence > 60 and recognised)), 2) as confidence from {EVERY_SQL} e group by doc_id)"


def _sep(page: str, pages: str) -> str:
    return f"chr(10) || chr(10) || '--- Página ' || {page} || ' de ' || {pages} || ' ---' || chr(10) || chr(10)"


TEXT_SQL = f"(select doc_id, string_agg({_sep('page', 'total_pages')} || text || case when coalesce(error, '') <> '' then chr(10) || '[ERROR: ' || error || ']' else '' end, '' order by page) as text from {EVERY_SQL} e group by doc_id)"


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.pass_confidence(table(spark, sf_dir, fixtures.OCR_WORDS), "doc_id", "page", "pass_no")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drivers.recognise(table(spark, sf_dir, fixtures.OCR_PASSES), table(spark, sf_dir, fixtures.OCR_WORDS))
    return found.withColumn("error", F.when(F.col("page") % 4 == 0, F.lit("ilegible")))


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.every_page(table(spark, sf_dir, fixtures.OCR_FILES), _results(spark, sf_dir))


_add("pass_confidence", _passes, f"select * from {PASS_SQL} p")
_add("best_pass", lambda s, d: recognition.best_pass(table(s, d, fixtures.OCR_PASSES).join(_passes(s, d), ["doc_id", "page", "pass_no"]), "doc_id", "page"), f"select doc_id, page, text, cast(confidence as double) as confidence from {BEST_SQL} b")
_add("page_lookup_default", _every, f"select * from {EVERY_SQL} e")
_add("document_confidence", lambda s, d: recognition.document_confidence(_every(s, d)), f"select * from {COUNT_SQL} c")
_add("assemble_document", lambda s, d: recognition.assemble(_every(s, d)), f"select * from {TEXT_SQL} t")

# --- whole documents


def _fields_sql(source: str) -> str:
    return f"(select *, {', '.join(f'{fields.sql_extract("text", f)} as {f}' for f in fields.PATTERNS)} from {source} fs)"


def _pairs_sql(alias: str = "") -> str:
    return "list_filter([" + ", ".join(f"{{'k': '{f}', 'v': {f}}}" for f in fields.PATTERNS) + "], lambda p: p.v is not null)"


def _keys():
    return F.array_join(F.transform(F.map_entries("key_values"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("found")


_KEYS_SQL = f"array_to_string(list_transform({_pairs_sql()}, lambda p: p.k || '=' || p.v), ';')"
LEGAL_PAGES = duckdb(fixtures.LEGAL_PAGES)
READ_SQL = f"""(select doc_id, count(*) as total_pages, coalesce(string_agg(case when error is not null then {_sep('page', 'n')} || '[Error extrayendo texto de la página ' || page || ']' when {sql_strip('text')} = '' then '' else {_sep('page', 'n')} || {sql_correct('text')} end, '' order by page), '') as text
 from (select *, count(*) over (partition by doc_id) as n from {LEGAL_PAGES} lp) p group by doc_id)"""
SCAN_SQL = f"(select t.doc_id, total_pages, processed_pages, low_confidence_pages, c.confidence, t.text from {TEXT_SQL} t join {COUNT_SQL} c on c.doc_id = t.doc_id)"
_SHOWN = ["doc_id", "success", "processing_method", "confidence", "total_pages", "processed_pages", "low_confidence_pages"]


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.process_text(table(spark, sf_dir, fixtures.LEGAL_PAGES))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.process_scanned(table(spark, sf_dir, fixtures.OCR_FILES), _results(spark, sf_dir))


READ_ROWS = f"select doc_id, true as success, 'text_extraction_enhanced' as processing_method, 95.0::double as confidence, total_pages, null::bigint as processed_pages, null::bigint as low_confidence_pages, {_KEYS_SQL} as found, text from {_fields_sql(READ_SQL)} r"
SCAN_ROWS = f"select doc_id, true as success, 'advanced_ocr' as processing_method, confidence, total_pages, processed_pages, low_confidence_pages, {_KEYS_SQL} as found, text from {_fields_sql(SCAN_SQL)} r union all select doc_id, false, null, 0, 0, null, null, null, '{drivers.NO_PAGES}' from {FILES} f where total_pages <= 0"
_add("process_text", lambda s, d: _read(s, d).select(*_SHOWN[:5], _keys(), "text"), f"select doc_id, success, processing_method, confidence, total_pages, found, text from ({READ_ROWS}) r")
_add("process_scanned", lambda s, d: _scanned(s, d).na.fill(-1, ["processed_pages", "low_confidence_pages"]).select(*_SHOWN, _keys(), "text"), f"select * replace (coalesce(processed_pages, -1) as processed_pages, coalesce(low_confidence_pages, -1) as low_confidence_pages) from ({SCAN_ROWS}) r")


def _named(done: DataFrame) -> DataFrame:
    return done.withColumns({"filename": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")), "language": F.lit("spa"), "file_size_mb": F.lit(1.5)})


_add(
    "json_response",
    lambda s, d: reports.json_response(_named(_scanned(s, d)), with_text=False).select("doc_id", F.get_json_object("response", "$.success").alias("success"), F.get_json_object("response", "$.pages_processed").alias("pages"), F.get_json_object("response", "$.extracted_fields.carpeta_fiscal").alias("carpeta"), F.get_json_object("response", "$.text").alias("text"), F.get_json_object("response", "$.error").alias("error")),
    f"select doc_id, case when success then 'true' else 'false' end as success, case when success then cast(total_pages as varchar) end as pages, nullif(regexp_extract(found, 'carpeta_fiscal=([^;]*)', 1), '') as carpeta, null::varchar as text, case when not success then text end as error from ({SCAN_ROWS}) x",
)
MD_FIELDS = "case when len(pairs) > 0 then chr(10) || '## Campos Extraídos' || chr(10) || chr(10) || array_to_string(list_transform(pairs, lambda p: '- **' || array_to_string(list_transform(string_split(p.k, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '**: ' || p.v), chr(10)) || chr(10) else '' end"
_add(
    "markdown_report",
    lambda s, d: reports.markdown_report(_named(_read(s, d))),
    f"""select doc_id, '# Procesamiento OCR - doc_' || doc_id || '.pdf' || chr(10) || chr(10) || '## Información del Procesamiento' || chr(10) || '- **Archivo**: doc_' || doc_id || '.pdf' || chr(10) || '- **Método**: text_extraction_enhanced' || chr(10) || '- **Páginas**: ' || total_pages || chr(10) || '- **Confianza**: 95.0%' || chr(10) || '- **Idioma**: spa' || chr(10) || '- **Tamaño**: 1.5MB' || chr(10)
    || {MD_FIELDS} || chr(10) || '## Contenido Extraído' || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || '---' as report from (select *, {_pairs_sql()} as pairs from {_fields_sql(READ_SQL)} r) x""",
)
_add(
    "batch_summary",
    lambda s, d: reports.batch_summary(_named(_scanned(s, d)).withColumn("batch", F.col("doc_id") % 3), "batch").select("batch", "total_files", "successful", "failed", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["filename"], r["pages"], F.coalesce(r["error"], F.lit("-")))), ",").alias("results")),
    f"select doc_id % 3 as batch, count(*) as total_files, cast(count_if(success) as bigint) as successful, cast(count_if(not success) as bigint) as failed, string_agg('doc_' || doc_id || '.pdf:' || total_pages || ':' || case when success then '-' else 'Processing failed' end, ',' order by doc_id) as results from ({SCAN_ROWS}) x group by 1",
)
_add("sidecar", lambda s, d: reports.sidecar(_named(_scanned(s, d))).select("doc_id", F.get_json_object("record", "$.method").alias("method"), F.get_json_object("record", "$.pages").alias("pages")), f"select doc_id, coalesce(processing_method, 'ocr') as method, cast(total_pages as varchar) as pages from ({SCAN_ROWS}) x")


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognised pages as they would arrive, from files of a folder, put together by the stream; the page of another document, long after them, ends their waiting."""
    folder = new_folder(spark, "arriving")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("doc_id", "page"), F.lit(600)))
    totals = table(spark, sf_dir, fixtures.OCR_FILES).where("total_pages > 0").select("doc_id", F.col("total_pages").cast("long").alias("total_pages"))
    pages = totals.join(_results(spark, sf_dir), "doc_id").select("doc_id", "total_pages", "page", "text", "confidence", "error", F.lit(0.0).alias("seconds"), at.alias("at"))
    last = spark.range(1).select(F.lit(-1).cast("long"), F.lit(1).cast("long"), F.lit(1), F.lit(""), F.lit(0.0), F.lit(None).cast("string"), F.lit(0.0), F.timestamp_seconds(F.lit(1_800_000_000)))
    pages.union(last).write.parquet(f"{folder}/in")
    arriving.follow(spark, f"{folder}/in", f"{folder}/out", f"{folder}/marks").awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("doc_id >= 0")


_add("process_arriving", lambda s, d: _arriving(s, d).select(*_SHOWN, _keys(), "text"), f"select * from ({SCAN_ROWS}) r where success")


def _process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload on its way; those that need recognition have no recogniser here, so their pages are missing."""
    pages = table(spark, sf_dir, fixtures.SINGLE_DOCS).withColumn("error", F.lit(None).cast("string"))
    nothing = spark.createDataFrame([], "doc_id long, page int, text string, confidence double, error string")
    return drivers.process(table(spark, sf_dir, fixtures.UPLOADS), pages, nothing)


_add(
    "process_uploads",
    lambda s, d: _process(s, d).select("doc_id", "filename", "language", "file_size_mb", "success", "processing_method", "confidence", "total_pages", F.length("text").alias("n_chars")),
    f"""select u.doc_id, {SAFE} as filename, {LANG} as language, round(u.length / 1048576, 2) as file_size_mb, true as success, case when way = 'text_extraction' then 'text_extraction_enhanced' else 'advanced_ocr' end as processing_method, case when way = 'text_extraction' then 95.0::double else 0 end as confidence, 1::bigint as total_pages,
    length({_sep('1', '1')} || case when way = 'text_extraction' then {sql_correct('t.text')} else '{recognition.MISSING}' end) as n_chars from {UPLOADS} u join {ROUTE_SQL} r on r.doc_id = u.doc_id join documents t on t.doc_id = u.doc_id""",
)

# --- rasters

POINTS = f"({fixtures.RASTERS_DUCKDB})"
BGR = "(select img, y, x, v as b, (v * 7 + 13) % 256 as g, (v * 3 + 101) % 256 as r from points)"


def _pixels(f: Callable | None = None, several: Callable | None = None) -> Query:
    """A step on whole rasters in a task."""
    return lambda s, d: rasters.as_points(rasters.map_pixels(fixtures.rasters(s, d, dealt=True), f, several)).select("img", "y", "x", "v")


def _points(f: Callable) -> Query:
    """A step on pixels as rows."""
    return lambda s, d: f(points.points_of(fixtures.rasters(s, d))).select("img", "y", "x", "v")


def _bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.rasters(spark, sf_dir, dealt=True).withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, (v * 7 + 13) % 256, (v * 3 + 101) % 256))))


MEAN_SQL = "(select p.img, p.y, p.x, case when any_value(p.v) > round(sum(q.v) / 121.0) - 2 then 255 else 0 end as v from points p, range(-5, 6) dy(dy), range(-5, 6) dx(dx), points q where q.img = p.img and q.y = greatest(0, least(7, p.y + dy.dy)) and q.x = greatest(0, least(7, p.x + dx.dx)) group by p.img, p.y, p.x)"
OTSU_LEVEL = """(select img, t from (select img, t, case when w0 > 0 and w1 > 0 then power(cast(s0 * n - w0 * s as double), 2) / cast(w0 * w1 as double) else 0 end as score from (
 select h.img, t, n, s, sum(case when v <= t then c else 0 end) as w0, sum(case when v > t then c else 0 end) as w1, sum(case when v <= t then c * v else 0 end) as s0 from (select img, v, count(*) as c from points group by all) h join (select img, count(*) as n, sum(v) as s from points group by img) z on z.img = h.img, range(0, 256) r(t) group by h.img, t, n, s) u) w qualify row_number() over (partition by img order by score desc, t) = 1)"""
OTSU_SQL = f"(select p.img, y, x, case when v > t then 255 else 0 end as v from points p join {OTSU_LEVEL} o on o.img = p.img)"


def _extreme_sql(source: str, name: str, low: int, high: int) -> str:
    return f"(select p.img, p.y, p.x, {name}(q.v) as v from {source} p join {source} q on q.img = p.img and q.y between p.y + {low} and p.y + {high} and q.x between p.x + {low} and p.x + {high} group by p.img, p.y, p.x)"


MORPH_SQL = f"with points as {POINTS}, o as {OTSU_SQL}, a as {_extreme_sql('o', 'min', -1, 0)}, b as {_extreme_sql('a', 'max', -1, 0)}, c as {_extreme_sql('b', 'max', -1, 1)}, d as {_extreme_sql('c', 'min', -1, 1)} select img, y, x, v from d"
_add("grayscale", lambda s, d: points.grayscale(points.colours_of(_bgr(s, d))).select("img", "y", "x", "v"), f"with points as {POINTS} select img, y, x, cast((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14 as int) as v from {BGR} c")
_add("otsu", _points(points.otsu), f"with points as {POINTS} select img, y, x, v from {OTSU_SQL} o")
_add("adaptive_mean", _points(points.adaptive_mean), f"with points as {POINTS} select img, y, x, v from {MEAN_SQL} m")
_add("combine_max", _points(lambda p: points.adaptive_mean(points.otsu(p, into="o"), into="m").withColumn("v", F.greatest("o", "m"))), f"with points as {POINTS} select m.img, m.y, m.x, greatest(m.v, o.v) as v from {MEAN_SQL} m join {OTSU_SQL} o on o.img = m.img and o.y = m.y and o.x = m.x")
_add("morphology", _points(lambda p: points.morphology(points.otsu(p))), MORPH_SQL)


def _kernel_sql(size: int, sigma: float) -> str:
    """step and w of a normalised Gaussian."""
    return f"(select step, w / sum(w) over () as w from (select step, exp(-cast(step * step as double) / {2 * sigma * sigma}) as w from range({-(size // 2)}, {size // 2 + 1}) r(step)) k)"


def _blur_sql(size: int, sigma: float, place: str) -> str:
    """img, y, x, v and the rounded Gaussian mean around a pixel; place: where in 0 to 7 a row or column number {} beyond the border is read."""
    k = _kernel_sql(size, sigma)
    return f"(select p.img, p.y, p.x, any_value(p.v) as v, round_even(sum(a.w * b.w * q.v), 0) as mean from points p, {k} a, {k} b, points q where q.img = p.img and q.y = {place.format('(p.y + a.step)')} and q.x = {place.format('(p.x + b.step)')} group by p.img, p.y, p.x)"


_BYTE = "cast(least(255, greatest(0, round_even({}, 0))) as int)"
GAUSS_SQL = f"(select img, y, x, case when v > mean - 2 then 255 else 0 end as v from {_blur_sql(11, 2.0, 'greatest(0, least(7, {}))')} b)"
SHARP_SQL = f"(select img, y, x, {_BYTE.format('(1 + 0.3::double) * v - 0.3::double * mean')} as v from {_blur_sql(7, 1.0, '(7 - abs(7 - abs({})))')} b)"


def _cubic_sql(t: str, k: int) -> str:
    """Weight of the k-th of four neighbours at distance t behind the second."""
    d = (f"({t} + 1)", t, f"(1 - {t})", f"(2 - {t})")[k]
    return f"(1.25 * {d} * {d} * {d} - 2.25 * {d} * {d} + 1)" if k in (1, 2) else f"(-0.75 * {d} * {d} * {d} + 3.75 * {d} * {d} - 6 * {d} + 3)"


_WEIGHT = lambda t, k: f"case {k} " + " ".join(f"when {i} then {_cubic_sql(t, i)}" for i in range(4)) + " end"
ROTATE_SQL = f"""(select s.img, s.y, s.x, {_BYTE.format(f"sum(q.v * ({_WEIGHT('fy', 'i.i')}) * ({_WEIGHT('fx', 'j.j')}))")} as v from (
 select *, sy - floor(sy) as fy, sx - floor(sx) as fx from (select img, y, x, sin(radians(10)) * (x - 4) + cos(radians(10)) * (y - 4) + 4 as sy, cos(radians(10)) * (x - 4) - sin(radians(10)) * (y - 4) + 4 as sx from points) r) s,
 range(0, 4) i(i), range(0, 4) j(j), points q where q.img = s.img and q.y = greatest(0, least(7, floor(sy) + i.i - 1)) and q.x = greatest(0, least(7, floor(sx) + j.j - 1)) group by s.img, s.y, s.x)"""
#: From the centres of 20 x 20 pixels to places among 8 x 8.
RESIZE_SQL = f"""(select s.img, s.y, s.x, {_BYTE.format(f"sum(q.v * ({_WEIGHT('fy', 'i.i')}) * ({_WEIGHT('fx', 'j.j')}))")} as v from (
 select *, sy - floor(sy) as fy, sx - floor(sx) as fx from (select img, cast(y as int) as y, cast(x as int) as x, (y + 0.5::double) / 2.5::double - 0.5::double as sy, (x + 0.5::double) / 2.5::double - 0.5::double as sx from (select distinct img from points) p, range(0, 20) a(y), range(0, 20) b(x)) r) s,
 range(0, 4) i(i), range(0, 4) j(j), points q where q.img = s.img and q.y = greatest(0, least(7, floor(sy) + i.i - 1)) and q.x = greatest(0, least(7, floor(sx) + j.j - 1)) group by s.img, s.y, s.x)"""
_RASTER_SQL = {
    "resize": RESIZE_SQL,
    "sharpen": SHARP_SQL,
    "adaptive_gaussian": GAUSS_SQL,
    "threshold": f"(select img, y, x, max(v) as v from (select img, y, x, v from {GAUSS_SQL} a union all select img, y, x, v from {MEAN_SQL} b union all select img, y, x, v from {OTSU_SQL} c) u group by all)",
    "rotate": ROTATE_SQL,
}
_add("raster_denoise", _pixels(several=image.denoise_all))
for _name, _f in {"resize": lambda g: image.resize(g, 2.5), "rotate": lambda g: image.rotate(g, 10.0)}.items():
    _add(f"raster_{_name}", _pixels(_f), f"with points as {POINTS} select img, y, x, v from {_RASTER_SQL[_name]} f" if _name in _RASTER_SQL else None)
for _name, _f in {"sharpen": points.sharpen, "adaptive_gaussian": points.adaptive_gaussian, "threshold": points.threshold}.items():
    _add(f"raster_{_name}", _points(_f), f"with points as {POINTS} select img, y, x, v from {_RASTER_SQL[_name]} f")


def _clahe_sql(h: int, w: int, clip: int = 3) -> str:
    """From points to img, y, x, v."""
    more = int(h % 8 > 0 or w % 8 > 0)
    th, tw = h // 8 + more, w // 8 + more
    area, limit = th * tw, max(1, clip * th * tw // 256)
    mirrored = lambda at, n: f"case when {at} < {n} then {at} else {2 * (n - 1)} - {at} end"
    far = lambda at, size: f"({at} / {size} - 0.5)"
    tile = lambda at, size, k: f"greatest(0, least(7, cast(floor({far(at, size)}) as int) + {k}))"
    corner = lambda i: f"join t c{i} on c{i}.img = p.img and c{i}.v = p.v and c{i}.ty = {tile('p.y', th, i // 2)} and c{i}.tx = {tile('p.x', tw, i % 2)}"
    side = lambda a, b: f"(c{a}.to_v * (1 - fx) + c{b}.to_v * fx)"
    return f"""big as (select p.img, p.v, cast(floor(a.y / {th}) as int) as ty, cast(floor(b.x / {tw}) as int) as tx from range(0, {th * 8}) a(y), range(0, {tw * 8}) b(x), points p where p.y = {mirrored('a.y', h)} and p.x = {mirrored('b.x', w)}),
n as (select img, ty, tx, v, count(*) as n from big group by all),
dense as (select k.img, k.ty, k.tx, r.v, coalesce(n.n, 0) as n from (select distinct img, ty, tx from n) k cross join range(0, 256) r(v) left join n on n.img = k.img and n.ty = k.ty and n.tx = k.tx and n.v = r.v),
spare as (select *, sum(greatest(n - {limit}, 0)) over (partition by img, ty, tx) as spare from dense),
cut as (select img, ty, tx, v, least(n, {limit}) + spare // 256 + case when spare % 256 > 0 and v % greatest(1, 256 // greatest(1, spare % 256)) = 0 and v // greatest(1, 256 // greatest(1, spare % 256)) < spare % 256 then 1 else 0 end as n from spare),
t as (select img, ty, tx, v, {_BYTE.format(f'sum(n) over (partition by img, ty, tx order by v) * 255 / {area}')} as to_v from cut),
p as (select *, {far('y', th)} - floor({far('y', th)}) as fy, {far('x', tw)} - floor({far('x', tw)}) as fx from points)
select p.img, p.y, p.x, {_BYTE.format(f'{side(0, 1)} * (1 - fy) + {side(2, 3)} * fy')} as v from p {' '.join(corner(i) for i in range(4))}"""


def _thin_sql(h: int, w: int, low: int = 50, high: int = 150) -> str:
    """From points to thin (img, y, x, s) and edge (img, y, x)."""
    side = lambda sign: f"s.img, s.y, s.x, s.y {sign} (case when s.steep < tan(radians(22.5)) then 0 else 1 end) as oy, s.x {sign} (case when s.steep < tan(radians(22.5)) then 1 when s.steep > tan(radians(67.5)) then 0 when s.same then 1 else -1 end) as ox"
    found = lambda name: f"select n.img, n.y, n.x, o.s as f from {name} n join s o on o.img = n.img and o.y = n.oy and o.x = n.ox"
    return f"""around as materialized (select p.img, p.y, p.x, a.d as dy, b.d as dx, greatest(0, least({h - 1}, p.y + a.d)) as qy, greatest(0, least({w - 1}, p.x + b.d)) as qx from points p, range(-1, 2) a(d), range(-1, 2) b(d)),
g as (select a.img, a.y, a.x, sum(q.v * dx * (2 - abs(dy))) as gx, sum(q.v * dy * (2 - abs(dx))) as gy from around a join points q on q.img = a.img and q.y = a.qy and q.x = a.qx group by a.img, a.y, a.x),
s as materialized (select img, y, x, abs(gx) + abs(gy) as s, abs(gy) / greatest(cast(abs(gx) as double), 1e-9) as steep, (gx >= 0) = (gy >= 0) as same from g),
before as materialized (select {side('-')} from s), after as materialized (select {side('+')} from s),
first as ({found('before')}), second as ({found('after')}),
thin as materialized (select s.img, s.y, s.x, s.s from s left join first a on a.img = s.img and a.y = s.y and a.x = s.x left join second b on b.img = s.img and b.y = s.y and b.x = s.x where s.s > coalesce(a.f, 0) and s.s >= coalesce(b.f, 0) and s.s > {low}),
edge as (select img, y, x from thin where s > {high} union select t.img, t.y, t.x from edge e join thin t on t.img = e.img and t.y between e.y - 1 and e.y + 1 and t.x between e.x - 1 and e.x + 1)"""


_EDGE_ROWS = "select p.img, p.y, p.x, case when e.img is null then 0 else 255 end as v from points p left join edge e on e.img = p.img and e.y = p.y and e.x = p.x"
SHEETS, LINES = fixtures.images_sql(fixtures.SHEETS, fixtures.SHEET_SIZE, "duckdb"), fixtures.images_sql(fixtures.LINES, fixtures.LINES_SIZE, "duckdb")
_sheets = lambda s, d: fixtures.images(s, d, fixtures.SHEETS, fixtures.SHEET_SIZE)
_add("raster_clahe", _points(points.clahe), f"with points as {POINTS}, {_clahe_sql(8, 8)}")
_add("raster_edges", _points(lambda p: points.edges(points.otsu(p))), f"with recursive raw as {POINTS}, points as (select img, y, x, v from {OTSU_SQL.replace('points', 'raw')} o), {_thin_sql(8, 8)} {_EDGE_ROWS}")
_add("sheet_clahe", lambda s, d: points.clahe(_sheets(s, d)).select("img", "y", "x", "v"), f"with points as {SHEETS}, {_clahe_sql(*fixtures.SHEET_SIZE)}")
_add("sheet_edges", lambda s, d: points.edges(_sheets(s, d), 300, 700).select("img", "y", "x", "v"), f"with recursive points as {SHEETS}, {_thin_sql(*fixtures.SHEET_SIZE, 300, 700)} {_EDGE_ROWS}")
_add(
    "lines_skew",
    lambda s, d: points.skews(fixtures.images(s, d, fixtures.LINES, fixtures.LINES_SIZE)).select("img", F.round("angle", 6).alias("angle")),
    f"""with recursive points as {LINES}, {_thin_sql(*fixtures.LINES_SIZE)},
tall as (select img, theta, rho, count(*) as n from (select img, t.theta, cast(round_even(x * cos(radians(t.theta)) + y * sin(radians(t.theta)), 0) as int) as rho from edge, range(0, 180) t(theta)) c group by all having count(*) > {max(100, fixtures.LINES_SIZE[1] // 10)}),
peak as (select * from tall a where not exists (select 1 from tall b where b.img = a.img and abs(b.theta - a.theta) + abs(b.rho - a.rho) = 1 and (b.n > a.n or b.n = a.n and b.theta + b.rho < a.theta + a.rho))),
ranked as (select img, theta, row_number() over (partition by img order by n desc, theta, rho) as k from peak)
select cast(p.img as bigint) as img, round(coalesce(a, 0), 6) as angle from (select distinct img from points) p left join (select img, median(theta - 90) as a from ranked where k <= 50 and theta - 90 between -30 and 30 group by img) m on m.img = p.img""",
)
_add("enhance", lambda s, d: rasters.map_pixels(_bgr(s, d), several=image.enhance_all).select("img", "height", "width", F.aggregate(rasters.levels(F.col("pixels")), F.lit(0), lambda a, v: a + v).alias("total")))
_add(
    "scale_choice",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", rasters.scale_choice((F.col("o_orderkey") % 97) * 40, (F.col("o_custkey") % 89) * 40).alias("scale")),
    "select o_orderkey, case when (o_orderkey % 97) * 40 * ((o_custkey % 89) * 40) < 1000000 then 2.5::double when (o_orderkey % 97) * 40 * ((o_custkey % 89) * 40) > 8000000 then 0.7::double else 1.2::double end as scale from orders",
)
_theta = lambda e: (e.cast("double") + 0.6) * (3.14159265358979 / 1.2)
SKEW_SQL = "(select vec_id, coalesce(median(a), 0) as angle from (select vec_id, case when pos <= 50 and a between -30 and 30 then a end as a from (select vec_id, pos, degrees((cast(embedding[pos] as double) + 0.6) * (3.14159265358979 / 1.2)) - 90 as a from (select vec_id, embedding, unnest(range(1, 65)) as pos from embeddings) e) f) g group by vec_id)"


def _skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", rasters.skew(F.transform("embedding", _theta)).alias("angle"))


_add("skew_median", lambda s, d: _skew(s, d).select("vec_id", F.round("angle", 6).alias("angle")), f"select vec_id, round(angle, 6) as angle from {SKEW_SQL} s")
_add("deskew_decision", lambda s, d: _skew(s, d).select("vec_id", rasters.needs_deskew(F.col("angle")).alias("deskew")), f"select vec_id, abs(angle) > 1 as deskew from {SKEW_SQL} s")
_add(
    "osd_rotation",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("Page: 1\nRotate: "), ((F.col("o_orderkey") % 5) * 90).cast("string"), F.lit("\n")).alias("osd")).select("o_orderkey", rasters.osd_rotation(F.col("osd")).alias("rotation"), rasters.needs_rotation(F.col("osd")).alias("rotate")),
    "select o_orderkey, cast((o_orderkey % 5) * 90 as int) as rotation, (o_orderkey % 5) * 90 % 360 <> 0 as rotate from orders",
)
_GOOD = f"{OK} and length <= {naming.MAX_BYTES}"
WAITING_SQL = f"(select count(*) as n_files, cast(count_if({_GOOD}) as bigint) as n_accepted, cast(count_if({_GOOD} and lower(filename) like '%.pdf') as bigint) as n_pdf, cast(count_if(not ({_GOOD})) as bigint) as n_refused, round(coalesce(sum(case when {_GOOD} then length else 0 end), 0) / 1048576, 2) as accepted_mb from {UPLOADS} u)"
_add(
    "service_health",
    lambda s, d: reports.health(s, files=table(s, d, fixtures.UPLOADS)).drop("timestamp", "recogniser_version").withColumn("supported_formats", F.array_join("supported_formats", ",")),
    f"select 'degraded' as status, '{__version__}' as version, cast(400 as int) as dpi, 'spa' as language, cast(100 as int) as max_file_size_mb, 60.0::double as confidence_threshold, 'bmp,jpeg,jpg,pdf,png,tiff' as supported_formats, w.* from {WAITING_SQL} w",
)
_add(
    "service_description",
    lambda s, d: reports.describe(s, table(s, d, fixtures.UPLOADS)),
    f"select name, purpose, case when name in ('analyze', 'process', 'batch') then n_accepted else n_files end as n_files from (values ('health', 'state of the engine'), ('analyze', 'how documents would be processed'), ('process', 'documents to text and fields'), ('batch', 'many documents with a summary')) t(name, purpose), {WAITING_SQL} w",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct legal documents and extract their fields."""
    return _wide(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


__all__ = ["Options", "flagship", "oracle_sql", "queries"]
