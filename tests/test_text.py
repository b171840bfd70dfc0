"""Rules of correction and extraction, against Python's own regular expressions and against cases written by hand."""

import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from escriba import registry
from escriba.functions import corrections, fields
from escriba.functions.regex import SPACES, arrow, java, re2, spelt, strip
from escriba.plans import fixtures

HAND = {
    "Ministerio Público": "MINISTERIO PÚBLICO",
    "la FlSCALÍA y la CARFETA": "la FISCALÍA y la CARPETA",
    "PENAЛ DELLTO Cöntra": "PENAL DELITO CONTRA",
    "carpeta fiscal :  0000000001-2020-1-1": "CARPETA FISCAL: 0000000001-2020-1-1",
    "EXP. N° 12345-2020-1-JR-PE": "EXPEDIENTE N° 12345-2020-1-JR-PE",
    "RESOLUCION N 12-3": "RESOLUCIÓN N° 12-3",
    "1-2/2020": "1/2/2020",
    "5 de marzo de 2024": "5 de marzo del 2024",
    "marzo de 2024": "marzo de-2024",
    "placa abc 123": "placa abc-123",
    "part 5": "pArtículo 5°",
    "Art. 12º": "Artículo 12°",
    "zinc 5": "zInciso 5",
    "a  \n\n b": "a b",
    "a\r\r\nb\tc": "a b c",
    "\x1c x  ": "x",
    "subcarpeta": "subcarpeta",
    "": "",
}


def python_correct(text):
    for right in dict.fromkeys(corrections.TOKENS.values()):
        for v in [right, *(wrong for wrong, to in corrections.TOKENS.items() if to == right)]:
            text = re.sub(rf"\b{re.escape(v)}\b", right, text, flags=re.I)
    for pattern, to in corrections.REWRITES.values():
        text = re.sub(pattern, to, text, flags=re.I)
    return text.strip()


def python_extract(text):
    out = {}
    for name, patterns in fields.PATTERNS.items():
        for p in patterns:
            if m := re.search(p, text, re.I):
                v = re.sub(r"[|#]+$", "", re.sub(r"\s+", " ", m[1 if m.lastindex else 0].strip())).strip()
                if v:
                    out[name] = v
                    break
    return out


FIELD_CASES = [
    "DELITO: USURPACIÓN ||\nIMPUTADO: JUAN, PÉREZ\nAGRAVIADO: ANA\n",
    "DELlTO: ||#\ncontra el patrimonio",
    "por usurpación agravada",
    "DISTRITO FISCAL DE LIMA\nSUR.\nFISCALÍA PROVINCIAL PENAL DE X DISTRITO",
    "FISCALÍA SUPERIOR DE ALGO\n",
    "1/2/2020 y el 5 de marzo del 2021",
    "FECHA: 1-2-2020",
    "JUZGADO PENAL TERCERO\nJUEZ: ANA\nMAGISTRADO: B",
    "JUEZ: ANA\r",
    "Fiscal: María Ñ",
    "INVESTIGADO: X DELITO",
    "RESOLUCION N° 12 3",
    "exp N: 1234-2020-1-JR-PE",
    "",
]


def test_hand_cases(spark):
    rows = spark.createDataFrame(list(HAND.items()), "text string, want string").select("text", "want", corrections.correct(F.col("text")).alias("got")).collect()
    assert not [r for r in rows if r.want != r.got]


def test_corrections_are_pythons(spark):
    words = ["Carpeta", "FISCAL", "FlSCAL", ":", "0000000001-2020-1-1", "\n", "  ", "\t", "Art.", "Inc", "12", "°", "ABC", "123", "de", "del", "2024", "3", "/", "-", "EXP", "N°", "1234-2020-1-JR-PE", "Л", "PENAЛ", " ", "\r", "é", "ſ", "́", "xy1234"]

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(words), max_size=14).map("".join), min_size=150, max_size=150))
    def same(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        for r in df.select("text", corrections.correct(F.col("text")).alias("got")).collect():
            assert r.got == python_correct(r.text), r.text

    same()


def test_fields_are_pythons(spark):
    texts = FIELD_CASES + [python_correct(t) for t in FIELD_CASES] + ["\n\n--- Página 1 de 1 ---\n\n" + t for t in FIELD_CASES]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", *fields.extract_columns(F.col("text"))).select("text", fields.as_map().alias("found")).select("*", F.map_keys("found").alias("names")).collect()
    for r in rows:
        assert r.found == python_extract(r.text), r.text
        assert r.names == [f for f in fields.PATTERNS if f in r.found]


def test_null_text_stays_null(spark):
    r = spark.createDataFrame([(None,)], "text string").select(corrections.correct(F.col("text")).alias("c"), fields.extract(F.col("text"), "delito").alias("d"), fields.long_date(F.col("text")).alias("l")).first()
    assert (r.c, r.d, r.l) == (None, None, None)


def test_dialects():
    assert java(r"\d[\s,]") == r"(?iud)[\p{Nd}][\t-\r\x1c-\x20\x85\p{Z},]"
    assert re2(r"a(?:b|$)") == r"(?i)a(?:b|\n?$)"


@pytest.mark.parametrize("broadcast", ["4k", "10m"])  # at 4k only nations are sent to all tasks
def test_tasks_of_legal_documents_stay_small(spark, monkeypatch, broadcast):
    """Their number follows the rows."""
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 100, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        n = [r["count"] for r in fixtures.table(spark, "/root/testdata/sf0.001", fixtures.LEGAL_DOCS).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(n) == 1500 and max(n) < 250


def test_tasks_of_legal_documents_stay_small_whoever_the_customer_is(spark, monkeypatch, tmp_path):
    """F14 extract_carpeta_fiscal, F15 extract_fiscal, F16 long_dates: all orders are one customer's."""
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 100)
    source = "/root/testdata/sf0.001"
    for name in ("customer", "nation"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{source}/orders.parquet").withColumn("o_custkey", F.lit(7).cast("long")).write.parquet(f"{tmp_path}/orders.parquet")
    n = [r["count"] for r in fixtures.table(spark, str(tmp_path), fixtures.LEGAL_DOCS).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 1500 and max(n) < 250


def test_spelt_patterns_match_the_same_characters(spark):
    """Every character of the basic plane, against Java's own way of ignoring case."""
    every = spark.createDataFrame([(chr(i),) for i in [*range(1, 0xD800), *range(0xE000, 0x10000)]], "c string")
    atoms = ["s", "k", "I", "e", "Í", "Л", r"\s", r"\w", r"\d", r"[A-ZÁÉÍÓÚÑ\s,]", "[ZS]", r"[-\s]", "[°º]", r"[:\s]"]
    whole = [F.count_if(F.col("c").rlike(f"^(?:{java(a)})\\z") != F.col("c").rlike(f"^(?:{spelt(a)})\\z")) for a in atoms]
    stripped = F.count_if((strip(F.col("c")) == "") != F.col("c").rlike(java(r"^\s\z")))
    assert list(every.agg(*whole, stripped).first()) == [0] * (len(atoms) + 1)


def test_words_that_share_a_separator_are_all_corrected(spark):
    """F1 extract_fields_wide, F2 extract_fields_map: edges of words are part of RE2's matches."""
    texts = ["fiscalia FISCALIA FISCALÍA fiscalía FlSCALÍA", "publico,publico,publico,publico", "subpublico publico publicos", "abc 123 ABC123 ABC-123 abc 123 abc\n123", "AB1234 ab 1234 AB-1234 ab 1234 xab 1234", "éabc 123 abc 123é abc 123", "MlNlSTERlO_ MlNlSTERlO", "PENAЛ penaл PENAЛ", "abc 123\x01abc 123", "abc\x85123 abc\u2003123 abc ٣٤٥"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", corrections.correct_tokens(F.col("text")).alias("tokens"), corrections.rewrite(F.col("text"), "R11", "R12").alias("plates")).collect()
    for r in rows:
        tokens, plates = r.text, r.text
        for wrong, right in [*((x, x) for x in corrections.TOKENS.values()), *corrections.TOKENS.items()]:
            tokens = re.sub(rf"\b{re.escape(wrong)}\b", right, tokens, flags=re.I)
        for name in ("R11", "R12"):
            plates = re.sub(*corrections.REWRITES[name], plates, flags=re.I)
        assert (r.tokens, r.plates) == (tokens, plates), r.text


@pytest.mark.parametrize("name", ["extract_fields_wide", "extract_fields_map"])
def test_all_fields_are_found_in_one_hop(spark, name):
    """F1 extract_fields_wide, F2 extract_fields_map: texts are corrected once and searched in batches, not by one pass of Java's patterns for each rule."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("_corrected(") == 1 and "regexp" not in plan


def test_arrow_patterns_match_the_same_characters(spark):
    """Every character of the basic plane, against Java's own way of ignoring case."""
    every = [chr(i) for i in [*range(1, 0xD800), *range(0xE000, 0x10000)]]
    rows = spark.createDataFrame([(c,) for c in every], "c string")
    for a in ["s", "k", "I", "e", "Í", "Л", r"\s", "[A-ZÁÉÍÓÚÑ\\s,]", "[ZS]", r"[-\s]", "[°º]", r"[:\s]"]:
        found = pc.match_substring_regex(pa.array(every), f"^(?:{arrow(a)})$").to_pylist()
        assert {c for c, f in zip(every, found) if f} == {r.c for r in rows.where(F.col("c").rlike(f"^(?:{java(a)})\\z")).collect()}, a
    assert set(pc.utf8_trim(pa.array(list(SPACES)), SPACES).to_pylist()) == {""}
