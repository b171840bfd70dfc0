import random

import numpy as np
import pyarrow as pa
import pytest

from escriba.llm import decontaminate, text
from escriba.llm.fm_index import FMIndex, suffix_array, symbols

from .conftest import frame, words


def data():
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "the", "x1"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((0, 1, 3, 13, 14, 20, 25, 13))] + [(8, None), (9, "The, A-b!"), (10, "the a b")]
    docs = [(i, text(rng.randint(0, 200)) + rng.choice(["", " ", f" {items[4][1]} ", f" {items[6][1]}."])) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "a " * 3000), (102, "a " * 3000), (103, "é日 the a B 😀")], items


@pytest.mark.parametrize("width", [3, 13])
def test_report_is_brute_forces(spark, width):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.report(frame(spark, docs), bench, width).collect())
    assert got == sorted(decontaminate.brute_force(docs, [(str(i), t) for i, t in items], width))


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontaminate.report(frame(spark, docs), bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert len(list(decontaminate.blocks(bench))) > 3
    assert sorted(tuple(r) for r in decontaminate.report(frame(spark, docs), bench).collect()) == whole


def test_blocks_answer_every_row(spark, monkeypatch):
    docs, items = data()
    docs += [(5, docs[7][1]), (5, docs[8][1] + " " + items[4][1]), *[(None, t) for _, t in docs[10:20]], (None, docs[10][1]), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert len(list(decontaminate.blocks(bench))) > 3
    got = sorted((tuple(r) for r in decontaminate.report(frame(spark, docs), bench).collect()), key=str)
    assert got == sorted(decontaminate.brute_force(docs, [(str(i), t) for i, t in items]), key=str)


def test_empty_tables(spark, empty, edges, edge_rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty, bench).count() == 0
    got = decontaminate.report(edges, bench).collect()
    assert len(got) == len(edge_rows) and not any(r.contaminated or r.n_hit for r in got)


def test_long_documents_are_cut(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST", 64)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate((500, 10, 33, 32, 31, 100))]
    items = [("i", docs[0][1][60:90]), ("j", docs[5][1][-26:])]
    n, found, spans = decontaminate.scan(pa.array([t for _, t in docs]), [decontaminate.phrases(items, 5)], 5)
    want = decontaminate.brute_force(docs, items, 5)
    assert [(int(a), sum(e - s for s, e in c), len(b)) for a, b, c in zip(n, found, spans, strict=True)] == [w[1:4] for w in want]


def test_keep_clean(spark):
    phrase = " ".join(f"q{i}" for i in range(13))
    docs = frame(spark, [(1, phrase), (2, "fine words " * 200 + phrase), (3, None)])
    kept = decontaminate.keep_clean(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_index():
    rng = np.random.default_rng(5)
    for _ in range(20):
        docs = [rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint8) for _ in range(rng.integers(1, 9))]
        docs += docs[:2]
        text = np.concatenate([np.append(d, 0) for d in docs]).astype(np.uint8)
        ends = np.flatnonzero(text == 0)
        whole = lambda p: (text[p : ends[np.searchsorted(ends, p)]].tolist() + [0], p)
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=whole)
        index = FMIndex(text)
        patterns = rng.integers(1, 4, (30, 4)).astype(np.uint8)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    assert symbols(np.array([0, 2**63], np.uint64)).min() >= 1


def test_blocks_are_read_once_for_many_slices(spark, monkeypatch):
    """Small slices and blocks: every block is asked for once for AT_ONCE slices, and the rows are those of plain comparison."""
    rng = random.Random(21)
    items = [(str(i), words(rng, rng.choice([3, 13, 40]), 60)) for i in range(30)]
    docs = [(i, words(rng, 60, 60) + " " + items[i % 30][1]) for i in range(90)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    batch = pa.record_batch({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    shared = [decontaminate.phrases(b) for b in decontaminate.blocks(spark.createDataFrame(items, "item_id string, text string"))]
    asked = []

    def one_at_a_time(blocks):
        for b in blocks:
            asked.append(1)
            yield b

    monkeypatch.setattr(decontaminate, "_one_at_a_time", one_at_a_time)
    parts = [(p, p.column(1)) for p in text.slices(batch, most=1500)]
    got = [(d, int(n), sum(e - s for s, e in c), len(b)) for rows, ns, bs, cs in decontaminate._searched(iter(parts), shared, 13) for d, n, b, c in zip(rows.column(0).to_pylist(), ns, bs, cs, strict=True)]
    assert got == [r[:4] for r in decontaminate.brute_force(docs, items)]
    assert len(shared) > 3 and len(parts) > 8 and len(asked) == len(shared) * -(-len(parts) // decontaminate.AT_ONCE)
