import json
import zipfile

from pyspark.sql import functions as F

from escriba.functions import naming
from escriba.plans import analysis, drivers, recognition, reports
from escriba.sources import sinks

PAGES = "doc_id long, page int, text string, image_count int"


def one(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_analysis(spark):
    pages = [(1, 1, "x" * 799, 0), (1, 2, "", 0), (2, 1, "x" * 798, 0), (3, 1, "y" * 900, 1), (4, 1, "short", 0), (5, 1, " ", 0), (6, 1, None, None)]
    pages += [(7, p, "z" * 300, int(p == 4)) for p in (4, 2, 1, 3)]
    got = one(analysis.analyze(spark.createDataFrame(pages, PAGES)))
    assert (got[1].text_length, got[1].processing_recommendation) == (799, "hybrid")
    assert got[2].processing_recommendation == "hybrid" and got[2].confidence == 0.7
    assert got[3].has_images and got[3].processing_recommendation == "hybrid"
    assert got[4].processing_recommendation == "ocr" and not got[4].has_text
    assert got[5].text_length == 0 and got[6].sample_text == ""
    # three pages with a space between, over four; the fourth page's image is not looked at
    assert (got[7].text_length, got[7].page_count, got[7].text_density) == (902, 4, 225.5)
    assert not got[7].has_images and got[7].processing_recommendation == "text_extraction"
    assert len(got[7].sample_text) == 500


def test_route(spark):
    rows = [("a.pdf", False, "text_extraction", "text_extraction"), ("a.PDF", True, "text_extraction", "ocr"), ("a.png", False, "text_extraction", "ocr"), ("a.pdf", False, None, "ocr"), ("a.pdf", False, "hybrid", "hybrid")]
    df = spark.createDataFrame(rows, "name string, force boolean, rec string, want string")
    assert not df.where(analysis.route(F.col("name"), F.col("force"), F.col("rec")) != F.col("want")).count()


def test_passes(spark):
    words = [(1, 1, 1, 90.0), (1, 1, 1, 0.5), (1, 1, 1, -1.0), (1, 1, 2, 90.9), (1, 2, 1, 0.9), (1, 3, 1, 50.0)]
    conf = recognition.pass_confidence(spark.createDataFrame(words, "doc_id long, page int, pass_no int, conf double"), "doc_id", "page", "pass_no")
    assert {(r.page, r.pass_no): r.avg_confidence for r in conf.collect()} == {(1, 1): 90.0, (1, 2): 90.0, (2, 1): 0.0, (3, 1): 50.0}
    text = [(1, 1, 1, "first", "d"), (1, 1, 2, "second", "d"), (1, 2, 1, "none", "default"), (1, 3, 1, "", "fallback")]
    passes = spark.createDataFrame(text, "doc_id long, page int, pass_no int, text string, default_text string").join(conf, ["doc_id", "page", "pass_no"])
    best = {r.page: (r.text, r.confidence) for r in recognition.best_pass(passes, "doc_id", "page").collect()}
    assert best == {1: ("first", 90.0), 2: ("default", 50.0), 3: ("fallback", 50.0)}


def test_scanned(spark):
    docs = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, total_pages long")
    results = spark.createDataFrame([(1, 3, "DELITO: X\n", 60.5, None), (1, 1, "", 60.0, "roto")], "doc_id long, page int, text string, confidence double, error string")
    got = one(drivers.process_scanned(docs, results))
    assert got[1].text == "\n\n--- Página 1 de 3 ---\n\n\n[ERROR: roto]\n\n--- Página 2 de 3 ---\n\n[Página no procesada]\n\n--- Página 3 de 3 ---\n\nDELITO: X\n"
    assert (got[1].confidence, got[1].processed_pages, got[1].low_confidence_pages) == (60.5, 1, 2)
    assert got[1].key_values == {"delito": "X"}
    assert not got[2].success and got[2].text == drivers.NO_PAGES


def test_text_documents(spark):
    pages = [(1, 2, "Art. 5", None), (1, 1, " \n ", None), (1, 3, None, "damaged")]
    got = one(drivers.process_text(spark.createDataFrame(pages, "doc_id long, page int, text string, error string")))
    assert got[1].text == "\n\n--- Página 2 de 3 ---\n\nArtículo 5°\n\n--- Página 3 de 3 ---\n\n[Error extrayendo texto de la página 3]"
    assert got[1].confidence == 95.0 and got[1].total_pages == 3


def test_names(spark):
    rows = [("a.PDF", True, "a.PDF", "a"), ("../x y.tar.png", True, "x_y.tar.png", "../x y.tar"), ("pdf", False, "pdf", "pdf"), (".pdf", True, "pdf", ".pdf"), ("Año.doc", False, "Ano.doc", "Año"), ("", False, "", ""), (None, False, None, None)]
    df = spark.createDataFrame(rows, "name string, ok boolean, safe string, stem string")
    for r in df.select("*", naming.allowed(F.col("name")).alias("a"), naming.safe_name(F.col("name")).alias("b"), naming.stem(F.col("name")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.ok, r.safe, r.stem), r


def done(spark):
    rows = [(1, True, "text_extraction_enhanced", 95.0, 2, {"carpeta_fiscal": "n", "juez": "x"}, "ñ text"), (2, False, None, 0.0, 0, None, "broken")]
    df = spark.createDataFrame(rows, "doc_id long, success boolean, processing_method string, confidence double, total_pages long, key_values map<string,string>, text string")
    ordered = F.create_map(F.lit("carpeta_fiscal"), F.lit("n"), F.lit("juez"), F.lit("x"))  # a Python dict comes without its order
    df = df.withColumn("key_values", F.when(F.col("success"), ordered))
    return df.withColumns({"filename": F.concat(F.lit("f"), F.col("doc_id"), F.lit(".pdf")), "language": F.lit("spa"), "file_size_mb": F.lit(0.5)})


def test_reports(spark, tmp_path):
    df = done(spark)
    answers = {r.doc_id: json.loads(r.response) for r in reports.json_response(df).collect()}
    assert answers[1]["extracted_fields"] == {"carpeta_fiscal": "n", "juez": "x"} and answers[1]["text"] == "ñ text"
    assert answers[2] == {"success": False, "error": "broken"}
    plain = {r.doc_id: json.loads(r.response) for r in reports.json_response(df, False, False).collect()}
    assert "text" not in plain[1] and "extracted_fields" not in plain[1]
    report = one(reports.markdown_report(df, reports.processed_footer()))[1].report
    assert "- **Carpeta Fiscal**: n\n- **Juez**: x\n" in report and report.startswith("# Procesamiento OCR - f1.pdf\n\n## ") and report.endswith("*")
    summary = reports.batch_summary(df.withColumn("b", F.lit("b")), "b").first()
    assert (summary.total_files, summary.successful, summary.failed) == (2, 1, 1)
    assert [r.error for r in summary.results] == [None, "Processing failed"]
    assert sinks.bundle(df, str(tmp_path / "z"), "b") == "lote_procesado_b.zip"
    with zipfile.ZipFile(tmp_path / "z" / "lote_procesado_b.zip") as z:
        assert sorted(z.namelist()) == ["f1.json", "f1.txt", "f2.json", "resumen_lote.json"]
        assert z.read("f1.txt").decode() == "ñ text" and json.loads(z.read("resumen_lote.json"))["failed"] == 1
    sinks.bundle(df.limit(0), str(tmp_path / "z"), "none")
    with zipfile.ZipFile(tmp_path / "z" / "lote_procesado_none.zip") as z:
        assert z.namelist() == ["resumen_lote.json"] and json.loads(z.read("resumen_lote.json")) == {"batch_id": "none", "total_files": 0, "successful": 0, "failed": 0, "language": "spa", "force_ocr": False, "results": []}
    many = df.crossJoin(spark.range(9).select((F.col("id") % 3).alias("batch_id"), (F.col("id") * 10).alias("n"))).withColumn("doc_id", F.col("doc_id") + F.col("n")).drop("n")
    sinks.write_bundles(many.repartition(5), str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == [f"lote_procesado_{i}.zip" for i in range(3)]
    with zipfile.ZipFile(tmp_path / "m" / "lote_procesado_1.zip") as z:
        assert len(z.namelist()) == 3 * 3 + 1 and {"f1_11.txt", "f1_41.txt", "f1_71.json", "f2_12.json"} <= set(z.namelist()) and json.loads(z.read("resumen_lote.json"))["total_files"] == 6
    sinks.write_texts(df.where("success"), str(tmp_path / "t"))
    assert sinks.read_texts(spark, str(tmp_path / "t")).first().text == "ñ text"
    sinks.write_text_files(df.where("success"), str(tmp_path / "f"))
    assert sinks.read_text_files(spark, str(tmp_path / "f")).first().text == "ñ text"
    sinks.write_records(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert reports.health(spark).first().status == "degraded" and reports.describe(spark).count() == 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGES)
    assert analysis.analyze(none).count() == 0
    assert drivers.process_text(none.withColumn("error", F.lit(None).cast("string"))).count() == 0


def test_sizes_of_refused_files_take_halves_to_the_even_digit(spark):
    sizes = {8192 * 100000: "781.2", 3 * 8192 * 100000: "2343.8", 104962458: "100.1", 1048576 * 199 + 996148: "200.0", 110000000: "104.9"}
    rows = spark.createDataFrame([(n,) for n in sizes], "length long").select("length", naming.request_error(F.lit(True), F.lit("a.pdf"), F.col("length")).alias("e")).collect()
    assert {r.length: r.e for r in rows} == {n: f"Archivo muy grande: {x}MB" for n, x in sizes.items()}
    assert all(f"{n / 1048576:.1f}" == x for n, x in sizes.items())
