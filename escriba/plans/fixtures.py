"""Inputs with the shape of legal documents, pages, recognition passes and rasters, made from the star-schema and text tables.

Each is one SELECT that Spark and DuckDB both understand; {names} in braces are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "orders", "events", "documents", "embeddings", "pages")

#: Legal documents that a task makes, and rasters that it works on as a whole, about.
ROWS_A_TASK, RASTERS_A_TASK = 50_000, 2_000

#: Where legal documents come from.
LEGAL_ROWS = "from {orders} o join {customer} c on o.o_custkey=c.c_custkey join {nation} n on c.c_nationkey=n.n_nationkey"

LEGAL_DOCS = """
select o.o_orderkey as doc_id, concat(
 case when o_orderkey%3=0 then 'MlNlSTERlO PUBLICO' else 'Ministerio  Público' end, chr(10),
 case when o_orderkey%4=0 then 'FlSCALÍA PROVINCIAL PENAL DE AREQUlPA DISTRITO' else 'FISCALIA PROVINCIAL CIVIL DE CHIVAY DISTRITO' end, chr(10),
 case when o_orderkey%6=0 then '' else concat('DISTRITO FISCAL DE ', translate(n_name,'_#0123456789','  ABCDEFGHIJ'), '.', chr(10)) end,
 case when o_orderkey%5=0 then '' else concat('CARPETA   FISCAL : ', lpad(cast(o_orderkey as string),10,'0'), '-', cast(year(o_orderdate) as string), '-', cast(o_custkey%999 as string), '-', cast(o_orderkey%10 as string), chr(10)) end,
 case when o_orderkey%7=0 then '' else concat('EXP. N° ', lpad(cast(o_custkey as string),5,'0'), '-', cast(year(o_orderdate) as string), '-', cast(o_orderkey%100 as string), '-JR-PE', chr(10)) end,
 case when o_orderkey%8=0 then 'INVESTIGADO: ' else 'IMPUTADO: ' end, translate(c_name,'#0123456789',' ABCDEFGHIJ'), chr(10),
 case when o_orderkey%9=0 then '' else concat('AGRAVIADO: ', translate(n_name,'_#0123456789','  ABCDEFGHIJ'), chr(10)) end,
 case when o_orderkey%11=0 then 'por USURPACION' else 'DELITO: USURPACION AGRAVADA ||' end, chr(10),
 'Art. ', cast(o_orderkey%400 as string), ' Inc ', cast(o_orderkey%9 as string), ' y part ', cast(o_custkey%10 as string), chr(10),
 case when o_orderkey%2=0 then concat(cast(day(o_orderdate) as string),' de marzo de ',cast(year(o_orderdate) as string)) when o_orderkey%13=0 then concat('marzo de ',cast(year(o_orderdate) as string)) else concat('FECHA: ',cast(day(o_orderdate) as string),'-',cast(month(o_orderdate) as string),'-',cast(year(o_orderdate) as string)) end, chr(10),
 case when o_orderkey%10=0 then '' else concat('RESOLUCION N ', cast(o_orderkey%50 as string), chr(10)) end,
 case when o_orderkey%3=1 then concat('JUZGADO PENAL ', translate(n_name,'_#0123456789','  ABCDEFGHIJ'), chr(10), 'JUEZ: ', translate(n_name,'_#0123456789','  ABCDEFGHIJ'), chr(10)) else '' end,
 case when o_orderkey%3=2 then concat('FISCAL: ', translate(n_name,'_#0123456789','  ABCDEFGHIJ'), chr(10), chr(10), chr(10)) else '' end,
 'PLACA ABC ', lpad(cast(o_orderkey%1000 as string),3,'0'), ' XY', chr(9), lpad(cast(o_custkey%10000 as string),4,'0')) as text
""" + LEGAL_ROWS + "\n"

#: The documents of a source are the pages of one file.
DOC_PAGES = "select source as doc_id, cast(row_number() over (partition by source order by doc_id) as int) as page, text, case when doc_id % 3 = 0 then 1 else 0 end as image_count from {documents}"

#: Every document is a file of one page.
SINGLE_DOCS = "select doc_id, 1 as page, text, case when doc_id % 3 = 0 then 1 else 0 end as image_count from {documents}"

#: A user's events are the words of a page, recognised in as many passes as there are kinds of events.
OCR_WORDS = """
select user_id % 30 as doc_id, cast(floor(user_id / 30) as int) + 1 as page, case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as pass_no, value / 4.9 as conf from {events}
"""

OCR_PASSES = f"""
select distinct doc_id, page, pass_no, case when page % 11 = 0 then '' else concat('CARPETA  FISCAL : 000000', cast(1000 + page as string), '-2020-', cast(pass_no as string), '-1  Art. ', cast(page as string)) end as text, concat('DELlTO: texto ', cast(page as string)) as default_text from ({OCR_WORDS}) w
"""

#: Files whose pages were recognised; some pages have no result, and a tenth of the files no page.
OCR_FILES = f"select doc_id, case when doc_id % 10 = 9 then 0 else max(page) + doc_id % 3 end as total_pages from ({OCR_WORDS}) w group by doc_id"

#: Legal documents as files of one to three pages, some unreadable.
LEGAL_PAGES = f"""
select doc_id - doc_id % 3 as doc_id, cast(doc_id % 3 + 1 as int) as page, case when doc_id % 7 = 0 then '  ' else text end as text, case when doc_id % 19 = 0 then 'damaged' end as error, case when doc_id % 5 = 0 then 1 else 0 end as image_count from ({LEGAL_DOCS}) l
"""

UPLOADS = """
select doc_id, concat(case when doc_id % 4 = 0 then '../Año ' else 'doc_' end, cast(doc_id as string), case doc_id % 6 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.tar.png' when 3 then '' when 4 then '.docx' else '.Jpeg' end) as filename, n_chars * 100000 as length, doc_id % 9 = 0 as force_ocr, case doc_id % 4 when 0 then 'spa' when 1 then 'eng' when 2 then 'deu' else 'spa+eng' end as language from {documents}
"""

#: The uploads, and a PDF that gives no page beside each.
AND_DAMAGED = f"select doc_id, filename, length from ({UPLOADS}) u union all select -1 - doc_id as doc_id, concat('damaged_', cast(doc_id as string), '.pdf') as filename, length from ({UPLOADS}) w"

#: 8 x 8 rasters from embeddings: img, y, x, v from 0 to 255. (Arrays are numbered from 1 in both engines' element access.)
RASTERS_SPARK = "select vec_id as img, cast(pos div 8 as int) as y, cast(pos % 8 as int) as x, cast(least(255, greatest(0, floor((cast(e as double) + 0.6) * 200))) as int) as v from {embeddings} lateral view posexplode(embedding) t as pos, e"
RASTERS_DUCKDB = "select vec_id as img, cast((pos - 1) // 8 as int) as y, cast((pos - 1) % 8 as int) as x, cast(least(255, greatest(0, floor((cast(embedding[pos] as double) + 0.6) * 200))) as int) as v from (select vec_id, embedding, unnest(range(1, 65)) as pos from embeddings)"


#: Images of 24 x 20 from embeddings, so that neither side is a multiple of eight: img, y, x, v. {numbers} are filled in for each engine.
SHEETS = "select vec_id as img, y, x, cast(least(255, greatest(0, floor((cast(embedding[(y * 7 + x * 3) % 64 {one}] as double) + 0.6) * 200))) as int) as v from {embeddings}, {ys}, {xs}"
SHEET_SIZE = (24, 20)

#: Black and white images of 128 x 160, one for each nation, with a slanting bar and a smaller one across: img, y, x, v.
LINES = "select n_nationkey as img, y, x, case when abs(y - 64 - (n_nationkey - 12) * 0.02 * (x - 80)) < 3 or abs(x - 30 - n_nationkey) < 2 and y > 100 then 0 else 255 end as v from {nation}, {ys}, {xs}"
LINES_SIZE = (128, 160)


def images_sql(sql: str, size: tuple[int, int], engine: str) -> str:
    """SHEETS or LINES for "spark" (tables stay in braces) or "duckdb"."""
    rows = (lambda name, n: f"(select explode(sequence(0, {n - 1})) as {name})") if engine == "spark" else (lambda name, n: f"(select cast(unnest(range(0, {n})) as int) as {name})")
    # elements are numbered from 0 in one and from 1 in the other
    out = sql.replace("{ys}", rows("y", size[0])).replace("{xs}", rows("x", size[1])).replace("{one}", "" if engine == "spark" else "+ 1")
    return out if engine == "spark" else duckdb(out)


def images(spark: SparkSession, sf_dir: str, sql: str, size: tuple[int, int]) -> DataFrame:
    """img, height, width, y, x, v."""
    found = table(spark, sf_dir, images_sql(sql, size, "spark"))
    return found.selectExpr("cast(img as bigint) as img", f"{size[0]} as height", f"{size[1]} as width", "y", "x", "v")


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if LEGAL_ROWS in sql:
        # texts are made, corrected and searched by the tasks that the joined rows are dealt to, whoever the customer is; a number of tasks that is asked for stays, however small their input looks
        tasks = max(spark.sparkContext.defaultParallelism, -(-used["orders"].count() // ROWS_A_TASK))
        legal = spark.sql(f"select o_orderkey, o_custkey, o_orderdate, c_name, n_name {LEGAL_ROWS}", **used).repartition(tasks)
        sql, used = sql.replace(LEGAL_ROWS, "from {legal} o"), {"legal": legal} | {t: f for t, f in used.items() if f"{{{t}}}" in sql.replace(LEGAL_ROWS, "")}
    return spark.sql(sql, **used)


def duckdb(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"


def rasters(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """img, height, width and the pixels of each raster, row by row. dealt: to as many tasks as work on whole rasters needs; a small file would be one task's."""
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if dealt:
        e = e.select("vec_id", "embedding").repartition(max(spark.sparkContext.defaultParallelism, -(-e.count() // RASTERS_A_TASK)))
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.6) * 200).cast("int"))))
    return e.select(F.col("vec_id").alias("img"), F.lit(8).alias("height"), F.lit(8).alias("width"), level.alias("pixels"))
