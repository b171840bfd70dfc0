"""Recognition: once for each page, measured, and outliving pages that kill their worker."""

import json
import os
import signal

import numpy as np
import pytest

from escriba import engine
from escriba.config import Options
from escriba.operators import attempts
from escriba.operators.engines import Recorded, recognise_files
from escriba.plans import reports

from .test_sources import pdf


class Pages:
    """Pages of one gray, which is their number."""

    def page_count(self, content):
        return content[0]

    def page(self, content, number, dpi):
        return np.full((6, 6, 3), number, np.uint8)


class Counting(Recorded):
    """Appends what it is asked for to a file."""

    def __init__(self, path, confidences=(80.0, 70.0, 90.0), deadly=()):
        super().__init__()
        self.path, self.confidences, self.deadly = path, confidences, deadly

    def note(self, what):
        with open(self.path, "a") as out:
            out.write(what + "\n")

    def words(self, img, language, segmentation, model):
        if int(img.flat[0]) in self.deadly:
            os.kill(os.getpid(), signal.SIGKILL)
        k = [("6", "3"), ("4", "3"), ("6", "1")].index((segmentation, model))
        self.note("words")

        def text():
            self.note("text")
            return f"CARFETA {int(img.flat[0])} pass {k + 1}"

        return text, [self.confidences[k]]

    def text(self, img, language):
        self.note("default")
        return "default"


PLAIN = {"enhance": False}


def files(spark, counts):
    return spark.createDataFrame([(i, bytes([n])) for i, n in enumerate(counts)], "doc_id long, content binary")


def test_texts_only_of_passes_that_improve(spark, tmp_path):
    found = recognise_files(files(spark, [2]), Pages(), Counting(tmp_path / "a"), **PLAIN).collect()
    assert [(r.page, r.text, r.confidence, r.as_is, r.error) for r in found] == [(1, "CARFETA 1 pass 3", 90.0, False, None), (2, "CARFETA 2 pass 3", 90.0, False, None)]
    asked = (tmp_path / "a").read_text().split()
    assert (asked.count("words"), asked.count("text"), asked.count("default")) == (6, 4, 0)
    [r] = recognise_files(files(spark, [1]), Pages(), Counting(tmp_path / "b", (0.0, -1.0, 0.9)), **PLAIN).collect()
    assert (r.text, r.confidence) == ("default", 50.0) and (tmp_path / "b").read_text().split().count("default") == 1


def test_a_page_that_kills_its_worker(spark, tmp_path):
    reader = Counting(tmp_path / "a", deadly=(3, 7))
    found = {(r.doc_id, r.page): r for r in attempts.recognise_surely(files(spark, [9, 2, 4]), Pages(), reader, at_once=2, **PLAIN).collect()}
    assert sorted(found) == [(d, p) for d, n in enumerate([9, 2, 4]) for p in range(1, n + 1)]
    dead = {k for k, r in found.items() if r.error}
    assert dead == {(0, 3), (0, 7), (2, 3)}
    assert all(found[k].text == f"[Error procesando página {k[1]}]" and found[k].error == "exit code -9" and found[k].confidence == 0 for k in dead)
    assert all(r.text == f"CARFETA {k[1]} pass 3" and r.seconds >= 0 for k, r in found.items() if k not in dead)


def test_a_page_that_takes_its_executor_along(spark, tmp_path, monkeypatch):
    """Where no process of its own saves the task, the page is given up after so many tries alone."""

    def together(f, *args):
        return f(*args), None

    monkeypatch.setattr(attempts, "in_own_process", together)
    found = {r.page: r for r in attempts.recognise_surely(files(spark, [5]).coalesce(1), Pages(), Counting(tmp_path / "a", deadly=(2,)), at_once=2, **PLAIN).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5] and found[2].error == "the executor was lost" and not any(found[p].error for p in (1, 3, 4, 5))


def test_a_failure_that_is_no_page_is_raised(spark, tmp_path):
    class Odd(Pages):
        def page_count(self, content):
            os._exit(3)

    with pytest.raises(Exception):  # noqa: B017
        attempts.recognise_surely(files(spark, [1]), Odd(), Counting(tmp_path / "a"), **PLAIN)


def test_each_step_runs_once(spark, tmp_path, monkeypatch):
    from escriba.sources import files as sources

    parsed = str(tmp_path / "parsed")
    plain = sources.page_texts

    def noted(*args):
        with open(parsed, "a") as out:
            out.write("x")
        return plain(*args)

    monkeypatch.setattr(sources, "page_texts", noted)

    class Two(Pages):
        def page_count(self, content):
            return 2

    text = "DELITO: HURTO\n" + "palabra " * 120
    rows = spark.createDataFrame([(1, "a.pdf", pdf(["", ""]), 2_000_000), (2, "b.pdf", pdf([text]), 1)], "doc_id long, filename string, content binary, length long")
    done = engine.process(rows, rasteriser=Two(), recogniser=Counting(tmp_path / "a"), options=Options(scale=1.0))
    got = {r.doc_id: r for r in done.collect()}
    asked = (tmp_path / "a").read_text().split()
    assert asked.count("words") == 6 and asked.count("default") == 0 and len(open(parsed).read()) == 2
    assert got[1].text.count("CARPETA") == 2 and "pass 3" in got[1].text and got[1].confidence == 90.0
    assert all(r.processing_time > 0 and r.processed_at is not None for r in got.values())
    answers = {r.doc_id: json.loads(r.response) for r in reports.json_response(done).collect()}
    assert all(a["processing_time"] >= 0 and a["timestamp"].startswith("20") for a in answers.values())
    assert len((tmp_path / "a").read_text().split()) == len(asked)
    whole = engine.batch(rows, "b", language="xx", rasteriser=Two(), recogniser=Counting(tmp_path / "c"), options=Options(scale=1.0)).first()
    assert (whole.total_files, whole.language, whole.system_info.dpi) == (2, "spa", 400) and all(r.processing_time is not None for r in whole.results)


def test_every_request_is_answered(spark, tmp_path):
    text = "JUEZ: ANA\n" + "palabra " * 120
    rows = [(1, "../a b.pdf", 10, pdf([text]), True), (2, "b.exe", 10, b"", True), (3, "c.pdf", 200 << 20, b"", True), (4, None, 0, None, False), (5, "", 0, b"", True), (6, "d.pdf", 10, b"%PDF-1.4 junk", True)]
    requests = spark.createDataFrame(rows, "doc_id long, filename string, length long, content binary, has_part boolean")
    got = {r.doc_id: r for r in engine.respond(requests).collect()}
    assert {d: r.status for d, r in got.items()} == {1: 200, 2: 400, 3: 413, 4: 400, 5: 400, 6: 500}
    said = {d: json.loads(r.response) for d, r in got.items()}
    assert said[1]["success"] and said[1]["extracted_fields"]["juez"] == "ANA" and "text" in said[1] and "processing_time" in said[1] and "timestamp" in said[1]
    assert said[3]["error"] == "Archivo muy grande: 200.0MB" and said[4]["error"] == "No se proporcionó archivo" and said[6]["error"] == "PDF no contiene páginas"
    assert got[1].stored_name.endswith("_a_b.pdf") and got[1].stored_name[:2] == "20" and got[2].stored_name is None
    as_md = {r.doc_id: r for r in engine.respond(requests, fmt="md").collect()}
    assert as_md[1].response.startswith("# Procesamiento OCR - a_b.pdf") and "**Tiempo**" in as_md[1].response and as_md[6].status == 500


def test_work_that_fails_as_a_whole_is_an_answer(spark, tmp_path):
    class Odd(Pages):
        def page_count(self, content):
            os._exit(3)

    requests = spark.createDataFrame([(1, "a.png", 10, b"x"), (2, "b.txt", 10, b"x")], "doc_id long, filename string, length long, content binary")
    got = {r.doc_id: r for r in engine.respond(requests, rasteriser=Odd(), recogniser=Counting(tmp_path / "a")).collect()}
    assert {d: r.status for d, r in got.items()} == {1: 500, 2: 400}
    said = json.loads(got[1].response)
    assert said["success"] is False and said["error"].startswith("Error procesando documento: ") and said["processing_time"] >= 0
