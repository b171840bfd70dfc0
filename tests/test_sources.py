import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from escriba import engine
from escriba.config import Options
from escriba.operators import adapters
from escriba.operators.engines import Recorded
from escriba.sources import files
from escriba.sources.pdf import page_texts
from escriba.streaming import folder


def pdf(pages, images=0, packed=False):
    """A small PDF file with a content stream for each page; text is shown line by line."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids, n = [], 3
    for text in pages:
        body = b"BT /F1 12 Tf " + b" ".join(b"(" + line.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*" for line in text.split("\n")) + b" ET"
        data = zlib.compress(body) if packed else body
        objects[n] = b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream"
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % n
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    names = b" ".join(b"/I%d %d 0 R" % (i, n) for i in range(images))
    if images:
        objects[n] = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\n0\nendstream"
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /XObject << %s >> >> >>" % (len(kids), b" ".join(kids), names)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_page_texts():
    assert page_texts(pdf(["uno (1)\ndos\\", "ñ"])) == [("uno (1)\ndos\\", 0, None), ("ñ", 0, None)]
    assert page_texts(pdf(["x"], images=2, packed=True)) == [("x", 2, None)]
    assert page_texts(pdf(["a", "b"]), max_pages=1) == [("a", 0, None), (None, 0, None)]
    assert page_texts(pdf(["a"]).replace(b"/Length", b"/Filter /LZWDecode /Length"))[0][2] is not None
    assert page_texts(b"") == page_texts(b"no pdf") == page_texts(b"%PDF-1.4 junk") == []


def with_font(font, shown, more=b""):
    body = b"BT /F1 12 Tf " + shown + b" Tj ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body), font]
    if more:
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(more), more))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_fonts():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<00D1> <D83DDE00>] endbfrange"
    composite = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H%s >>"
    assert page_texts(with_font(composite % b" /ToUnicode 6 0 R", b"<00240025000300300031>", cmap)) == [("AB Ñ😀", 0, None)]
    assert page_texts(with_font(composite % b"", b"<00240025>"))[0][2] == "a composite font without a map to characters"
    assert page_texts(with_font(b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", b"(\x93a\x94 \x80)")) == [("“a” €", 0, None)]
    assert page_texts(with_font(b"<< /Type /Font /Subtype /Type1 /Encoding /MacRomanEncoding >>", b"(a\x96o)")) == [("año", 0, None)]
    assert page_texts(with_font(b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /A /ntilde /uni00E9 /fi] >> >>", b"(\\001\\002\\003\\004x)")) == [("Añéfix", 0, None)]
    assert page_texts(with_font(b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /g17] >> >>", b"(\\001)"))[0][2] == "a font with unknown glyph names"


def test_adapters(monkeypatch):
    import sys
    import types

    assert all(x is None or hasattr(x, "page") or hasattr(x, "words") for x in adapters.available())
    img = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    asked = []
    ocr = types.SimpleNamespace(Output=types.SimpleNamespace(DICT="dict"), image_to_data=lambda p, **k: asked.append(k) or {"conf": ["-1", 90, "80.5"]}, image_to_string=lambda p, **k: "text", image_to_osd=lambda p, **k: {"rotate": 90})
    pil = types.SimpleNamespace(Image=types.SimpleNamespace(fromarray=lambda a: a))
    monkeypatch.setitem(sys.modules, "pytesseract", ocr)
    monkeypatch.setitem(sys.modules, "PIL", pil)
    t = adapters.Tesseract()
    text, found = t.words(img, "spa", "6", "3")
    assert text() == "text" and found == [-1.0, 90.0, 80.5] and t.rotation(img) == 90 and t.text(img, "spa") == "text"
    assert asked[0]["lang"] == "spa" and asked[0]["config"].startswith("--psm 6 --oem 3 --dpi 400")


def test_pages_that_fail(spark):
    class Pages:
        def page_count(self, content):
            return 4

        def page(self, content, number, dpi):
            if number == 1:
                raise ValueError("torn")
            return None if number == 2 else np.full((number, 4, 3), 255, np.uint8)

    class Reader(Recorded):
        def text(self, img, language):
            if img.shape[0] == 3:
                raise ValueError("no ink")
            raise MemoryError

        def words(self, img, language, segmentation, model):
            if img.shape[0] != 3:
                raise MemoryError
            return "", []

    files = spark.createDataFrame([(1, "a.pdf", pdf([""] * 4), 1)], "doc_id long, filename string, content binary, length long")
    text = engine.process(files.withColumns({"language": F.lit("spa")}), rasteriser=Pages(), recogniser=Reader(), options=Options(scale=1.0)).first().text
    assert [p.strip() for p in re.split(r"--- Página \d de \d ---", text)][1:] == ["[Error convirtiendo página 1: torn]\n[ERROR: torn]", "[Página no disponible]", "Error en OCR: no ink", "[Error procesando página 4]\n[ERROR: MemoryError]"]


def test_engine(spark, tmp_path):
    text = "DELITO: HURTO\n" + "palabra " * 120
    (tmp_path / "a.pdf").write_bytes(pdf([text], packed=True))
    (tmp_path / "b.pdf").write_bytes(pdf([""]))
    (tmp_path / "c.png").write_bytes(b"anything")
    (tmp_path / "d.txt").write_bytes(b"not accepted")
    rows = files.uploads(spark, str(tmp_path))
    seen = {r.filename: r for r in engine.analyze(rows).collect()}
    assert sorted(seen) == ["a.pdf", "b.pdf", "c.png"]
    assert seen["a.pdf"].processing_recommendation == "text_extraction" and seen["b.pdf"].processing_recommendation == "ocr"
    assert seen["c.png"].confidence == 0.8 and seen["c.png"].page_count is None

    class Pages:
        def page_count(self, content):
            return 2

        def page(self, content, number, dpi):
            if number == 2:
                raise ValueError("no page")
            return np.full((4, 4, 3), 255, np.uint8)

    class Reader(Recorded):
        def words(self, img, language, segmentation, model):
            return "JUEZ: ANA\n", [80.0, 0.0, 90.0]

    got = {r.filename: r for r in engine.process(rows, rasteriser=Pages(), recogniser=Reader()).collect()}
    assert got["a.pdf"].processing_method == "text_extraction_enhanced" and got["a.pdf"].key_values["delito"] == "HURTO"
    assert got["b.pdf"].processing_method == "advanced_ocr" and got["b.pdf"].confidence == 85.0
    assert got["c.png"].total_pages == 1 and got["c.png"].key_values == {"juez": "ANA"}
    assert engine.batch(rows, "b1").first().total_files == 3


def test_stream(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for i in range(2):
        spark.createDataFrame([(i, f"DELITO: D{i}\n")], "doc_id long, text string").write.mode("append").parquet(source)
        folder.ingest(spark, source, target, marks).awaitTermination()
    assert sorted((r.doc_id, r.key_values["delito"]) for r in spark.read.parquet(target).collect()) == [(0, "D0"), (1, "D1")]
