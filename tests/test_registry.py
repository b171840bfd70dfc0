"""Registered queries against their SQL, and the routes that must not be vacuous."""

import os

import duckdb
import pytest

from escriba import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
NAMES = ["process_arriving", "raster_clahe", "raster_edges", "sheet_clahe", "sheet_edges", "lines_skew", "raster_sharpen", "raster_adaptive_gaussian", "raster_threshold", "grayscale", "combine_max", "morphology", "correct_tokens", "correct_full", "extract_fields_map", "analyze_pages", "analyze_files", "file_names", "request_errors", "best_pass", "process_scanned", "process_text", "markdown_report", "batch_summary", "process_uploads", "adaptive_mean", "otsu", "skew_median", "raster_rotate", "service_description", "service_health"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "events", "documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, tables, name):
    def show(v):
        return round(v, 6) if isinstance(v, float) else v

    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([show(r[c]) for c in columns]) for r in df.collect())
    rel = tables.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([show(r[i]) for i in at]) for r in rel.fetchall())
    assert len(got) == len(want) and got == want
    assert sorted(rel.columns) == columns


def test_every_field_is_found(spark):
    rows = registry.queries()["field_coverage"](spark, SF).collect()
    assert len(rows) == 11 and all(r.n > 100 for r in rows)
    assert registry.queries()["extract_raw_fiscal"](spark, SF).where("value is not null").count() == 500


def test_entry_without_the_corpus_operators(monkeypatch):
    """Whatever can't be imported of them, all other queries stay."""
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "escriba.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_a_missing_library_hides_the_corpus_operators_only():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; from escriba import registry; assert set(e.queries()) == set(registry.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_queries_need_no_session():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_without_corpus_operators_that_were_imported_before(monkeypatch):
    import sys

    import __spark_entry__ as entry
    import escriba.llm.queries

    monkeypatch.setitem(sys.modules, "escriba.llm.queries", None)
    assert "op6_pii" not in entry.queries() and "op6_pii" not in entry.oracle_sql()
