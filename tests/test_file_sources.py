"""The page source and the writer of named files."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringEndsWith
from pyspark.sql.types import StructType

from escriba import engine
from escriba.sources import files, page_source, pdf, sinks

from .test_sources import pdf as make

FIELDS = [c.split()[0] for c in page_source.SCHEMA.split(", ")]


def reader(folder, columns=FIELDS, part_bytes=1 << 20):
    r = page_source.PageSource({"path": str(folder), "part_bytes": str(part_bytes)})
    return r.reader(StructType.fromDDL(", ".join(c for c in page_source.SCHEMA.split(", ") if c.split()[0] in columns)))


def read(r):
    return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "big.pdf").write_bytes(make([f"hoja {i}" for i in range(1, 41)]))
    (tmp_path / "in" / "b.pdf").write_bytes(make(["uno", "dos"], images=1))
    (tmp_path / "in" / "deep" / "e.pdf").write_bytes(make(["lejos"]))
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF-1.4 junk")
    (tmp_path / "in" / "d.txt").write_bytes(b"")
    return tmp_path / "in"


def test_only_asked_pages_are_parsed(spark, folder, monkeypatch):
    parsed = []
    plain = pdf.Document.text
    monkeypatch.setattr(pdf.Document, "text", lambda self, page: parsed.append(1) or plain(self, page))
    assert len(read(reader(folder))) == 42 and len(parsed) == 42
    for filters, pages in ([LessThanOrEqual(("page",), 3)], 5), ([EqualTo(("page",), 2), StringEndsWith(("path",), "b.pdf")], 1), ([GreaterThan(("page",), 38)], 2), ([In(("page",), (1, 40, 41)), LessThanOrEqual(("page",), 40)], 3):
        parsed.clear()
        r = reader(folder)
        assert list(r.pushFilters(filters)) == [] and len(read(r)) == pages == len(parsed)
    parsed.clear()
    odd = [EqualTo(("text",), "x"), EqualTo(("page",), 1)]
    r = reader(folder, ["path", "page", "page_count"])
    assert list(r.pushFilters(odd)) == odd[:1] and [(x["page"], x["page_count"]) for x in read(r)] == [(1, 2), (1, 40)] and not parsed


def test_a_big_file_is_many_tasks(spark, folder):
    r = reader(folder, part_bytes=500)
    parts = r.partitions()
    big = [p for p in parts if p.files[0][0].endswith("big.pdf")]
    assert len(big) > 5 and all(len(p.files) == 1 for p in big)
    assert sorted(x["page"] for p in big for b in r.read(p) for x in b.to_pylist()) == list(range(1, 41))
    r.pushFilters([LessThanOrEqual(("page",), 3)])
    list(r.pushFilters([LessThanOrEqual(("page",), 3)]))
    assert sum(p.files[0][0].endswith("big.pdf") for p in r.partitions()) == 3
    assert len(reader(folder).partitions()) == 1


def test_source_and_routing(spark, folder):
    pages = page_source.folder_pages(spark, str(folder))
    plain = files.pdf_pages(files.uploads(spark, str(folder)))
    assert sorted(map(str, pages.select("doc_id", "page", "text", "image_count", "error").collect())) == sorted(map(str, plain.select("doc_id", "page", "text", "image_count", "error").collect()))
    first = pages.where("page <= 3").select("page", "text")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert first.count() == 5 and "Filter " not in plan
    got = {r.filename: r.asDict() for r in engine.analyze_folder(spark, str(folder)).collect()}
    want = {r.filename: r.asDict() for r in engine.analyze(files.uploads(spark, str(folder))).collect()}
    assert got == want and got["big.pdf"]["page_count"] == 40
    assert spark.read.format("document_pages").option("recursive", True).load(str(folder)).where("text = 'lejos'").count() == 1


def test_empty_folder(spark, tmp_path):
    assert page_source.folder_pages(spark, str(tmp_path)).collect() == []


DONE = "doc_id long, filename string, success boolean, text string, total_pages long, processing_method string, confidence double, key_values map<string,string>, file_size_mb double"


def test_documents_as_named_files(spark, tmp_path):
    rows = [(1, "a.pdf", True, "uno\n\ná", 1, "m", 90.0, {"juez": "ANA"}, 1.0), (2, "b.c.pdf", False, "roto", 0, None, 0.0, None, 1.0), (3, "a.png", True, None, 1, "m", 50.0, {}, 1.0), (4, ".pdf", True, "x", 1, "m", 50.0, {}, 1.0)]
    target = tmp_path / "out"
    sinks.write_documents(spark.createDataFrame(rows, DONE).repartition(3), str(target))
    names = set(os.listdir(target))
    assert {"a_1.txt", "a_1.json", "a_3.txt", "a_3.json", "b.c.json"} <= names and len(names) == 7 and not any(n.startswith("_temporary") for n in names)
    assert (target / "a_1.txt").read_text() == "uno\n\ná" and (target / "a_3.txt").read_text() == ""
    assert json.loads((target / "a_1.json").read_text())["extracted_fields"] == {"juez": "ANA"}


def test_failed_jobs_leave_nothing(spark, tmp_path):
    from escriba.sources.named_files import NamedFiles

    spark.dataSource.register(NamedFiles)
    target = str(tmp_path / "out")
    good = spark.range(20, numPartitions=4).select(F.concat(F.lit("f"), "id").alias("name"), F.lit("old").alias("content"))
    good.write.format("named_files").mode("append").save(target)
    bad = good.select(F.when(F.col("name") == "f17", "../x").otherwise(F.col("name")).alias("name"), F.lit("new").alias("content"))
    with pytest.raises(Exception, match="no name of a file"):
        bad.write.format("named_files").mode("append").save(target)
    names = [n for n in os.listdir(target) if not n.startswith(".")]
    assert len(names) == 20 and all((tmp_path / "out" / n).read_text() == "old" for n in names)
    raw = good.limit(2).select("name", F.lit(b"\x00\xff").alias("content"))
    raw.write.format("named_files").mode("overwrite").save(target)
    assert sorted(n for n in os.listdir(target) if not n.startswith(".")) == sorted(r.name for r in raw.collect()) and (tmp_path / "out" / "f0").read_bytes() == b"\x00\xff"
