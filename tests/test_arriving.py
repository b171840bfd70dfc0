"""Pages that arrive in any order give the answers of a batch."""

import random
from datetime import datetime, timedelta

import pytest

from escriba.plans import drivers
from escriba.streaming import arriving

START = datetime(2024, 1, 1)


def page(doc, total, n, minute=0, text=None, confidence=None, error=None):
    return (doc, total, n, text if text is not None else f"DELITO: D{doc}\nhoja {n} á\n", confidence if confidence is not None else 50.0 + (doc * 7 + n * 13) % 50, error, 0.25, START + timedelta(minutes=minute))


def batch(spark, rows):
    totals = sorted({(r[0], r[1]) for r in rows})
    results = spark.createDataFrame(rows, arriving.PAGES).select("doc_id", "page", "text", "confidence", "error", "seconds")
    done = drivers.process_scanned(spark.createDataFrame(totals, "doc_id long, total_pages long"), results)
    return {r.doc_id: r for r in done.collect()}


@pytest.fixture
def run(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def arrive(rows, **more):
        spark.createDataFrame(rows, arriving.PAGES).coalesce(1).write.mode("append").parquet(source)
        query = arriving.follow(spark, source, target, marks, **more)
        query.awaitTermination()
        return {r.doc_id: r for r in spark.read.parquet(target).collect()}

    return arrive


def test_any_order_and_a_restart(spark, run):
    rows = [page(d, n, p, error="ilegible" if p == 2 and d % 3 == 0 else None) for d, n in enumerate([1, 3, 7, 2, 12, 5]) for p in range(1, n + 1)]
    random.Random(5).shuffle(rows)
    want = batch(spark, rows)
    first = run(rows[:13])
    # each call is a new query that goes on from the checkpoint
    whole = {d for d, n in enumerate([1, 3, 7, 2, 12, 5]) if sum(r[0] == d for r in rows[:13]) == n}
    assert set(first) == whole and len(whole) < 6
    second = run(rows[13:22])
    assert set(first) <= set(second)
    got = run(rows[22:])
    assert got == want


def test_missing_pages_are_filled_and_late_ones_dropped(spark, run):
    rows = [page(1, 4, 1), page(1, 4, 3), page(2, 2, 1)]
    assert run(rows, wait_seconds=600, late="1 minute") == {}
    # time goes on with another document; 1 and 2 have waited long enough
    later = [page(3, 1, 1, minute=60), page(2, 2, 2, minute=5)]
    got = run(later, wait_seconds=600, late="1 minute")
    assert set(got) == {1, 2, 3} and got[2] == batch(spark, [rows[2], later[1]])[2]
    assert got[1] == batch(spark, rows[:2])[1] and got[1].text.count("[Página no procesada]") == 2
    after = run([page(1, 4, 2, minute=61)], wait_seconds=600, late="1 minute")
    assert after == got


def test_repeated_and_unusable_pages(spark, run):
    rows = [page(1, 2, 1, confidence=70.0, text="weak"), page(1, 2, 1, confidence=90.0, text="strong"), page(1, 2, 1, confidence=80.0, text="late"), page(1, 2, 5), (None, 2, 1, "x", 1.0, None, 0.0, START), (2, None, 1, "x", 1.0, None, 0.0, START), (2, 2, 0, "x", 1.0, None, 0.0, START), (3, 1, 1, None, None, None, None, START)]
    assert set(run(rows)) == {3}
    got = run([page(1, 2, 2)])
    assert set(got) == {1, 3} and "strong" in got[1].text and got[3].text == "\n\n--- Página 1 de 1 ---\n\n" and got[3].confidence == 0.0
