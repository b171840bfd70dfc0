"""Rows without a doc_id, rows of one doc_id with different texts, columns of clashing names, words that differ far behind, hashes that clash."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from escriba.llm import byte_bpe, decontaminate, licenses, neardup, pii, quality, runs, substring_dedup, text, token_count, token_files, toxicity

from .conftest import frame, words

ROWS = [(None, "Some words stand here, and more of them. Mail a@b.org now."), (None, None), (None, "Some words stand here, and more of them. Mail a@b.org now."), (1, "x"), (1, "y z"), (2, None)]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tables(spark):
    return frame(spark, ROWS), spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "x"), (None, "y z"), (3, None)], "item_id long, text string")


REPORTS = {
    "op1": lambda d, l, b: toxicity.report(d, l),
    "op2": lambda d, l, b: licenses.report(d),
    "op3": lambda d, l, b: substring_dedup.remove(d),
    "op4": lambda d, l, b: neardup.report(d),
    "op5": lambda d, l, b: token_count.report(d, WORD),
    "op6": lambda d, l, b: pii.report(d),
    "op7": lambda d, l, b: token_files.report(d, WORD),
    "op8": lambda d, l, b: byte_bpe.report(d, BYTE, public_tokenizers.PATTERN),
    "op9": lambda d, l, b: quality.report(d),
    "op10": lambda d, l, b: decontaminate.report(d, b),
    "op12": lambda d, l, b: runs.report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_every_row_is_answered(tables, name):
    got = REPORTS[name](*tables).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in ROWS), key=str)
    if name == "op4":
        assert all((r.component_id, r.kept) == (None, True) for r in got if r.doc_id is None)


@pytest.mark.parametrize("stage", [lambda d, l, b: toxicity.keep_clean(d, toxicity.train(d, l)), lambda d, l, b: neardup.keep_first(d, 5), lambda d, l, b: decontaminate.keep_clean(d, b), lambda d, l, b: pii.redact(d, pii.train(d))])
def test_stages_keep_columns_and_rows_without_an_id(tables, stage):
    out = stage(*tables)
    assert out.columns == tables[0].columns
    rows = out.collect()
    assert sum(r.doc_id is None for r in rows) == 3
    assert all((r["__text"], r["__gone"], r.gone, r.mark) == ("t", 5, 6, 3) for r in rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_edges_and_nothing(spark, tmp_path, edges, empty, stage):
    """Every stage on null, empty, long and repeated texts beside columns of clashing names, and on empty tables."""
    spark.createDataFrame([(900, 1, 1), (903, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, empty, str(tmp_path)).collect() == []
    got = sorted(r.doc_id for r in stage(spark, edges, str(tmp_path)).collect())
    assert got == sorted(r.doc_id for r in edges.collect())
    nobody = stage(spark, frame(spark, ROWS), str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in nobody) == 3


def exchanged():
    rng = random.Random(5)
    a = [rng.choice("etaoinsr") for _ in range(70_000)]
    b = list(a)
    j = next(j for j in range(100, 1000) if a[j] != a[j + 65_536])
    b[j], b[j + 65_536] = b[j + 65_536], b[j]
    return "".join(a), "".join(b)


def test_long_words_that_differ(spark):
    a, b = exchanged()
    tail = " one two three. Four five six seven eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen seventeen eighteen nineteen twenty more words than that."
    rows = [(1, a), (2, b), (3, a), (4, f"{a}{tail}"), (5, f"{b}{tail}")]
    assert sorted(tuple(r) for r in neardup.report(frame(spark, rows)).collect()) == sorted(neardup.brute_force(rows))
    items = [("1", a), ("2", "x " + b)]
    got = decontaminate.report(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(decontaminate.brute_force(rows, items))
    found = substring_dedup.remove(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in found) == sorted(substring_dedup.brute_force(rows))


def test_hits_are_compared_by_their_bytes(monkeypatch):
    plain = text.fingerprints

    def weak(*a):
        h, check = plain(*a)
        return (h & np.uint64(3)) << np.uint64(40), check

    monkeypatch.setattr(text, "fingerprints", weak)
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["a", "bb", "the", "x1", "of", "to"]) for _ in range(n))
    items = [(str(i), some(n)) for i, n in enumerate((1, 2, 3, 5, 9))]
    docs = [(i, some(rng.randint(0, 60)) + " " + items[i % 5][1]) for i in range(40)]
    n, found, spans = decontaminate.scan(pa.array([t for _, t in docs]), [decontaminate.phrases(items, 4)], 4)
    want = decontaminate.brute_force(docs, items, 4)
    assert [(int(a), sum(e - s for s, e in c), len(b)) for a, b, c in zip(n, found, spans, strict=True)] == [w[1:4] for w in want]


def test_spans_in_long_tokens():
    body = ["id=" + "x" * 200 + "|" + "y" * 200 + "|12.34.56.78|" + "z" * 50, "9" * 400]
    assert [n.body for n in pii.nodes(body[0])] == ["12.34.56.78"] and [len(n.body) for n in pii.nodes(body[1])] == [400]


@pytest.mark.parametrize("n", [1, 300, 319, 320, 321, 5000])
def test_tokens_of_any_length_are_cut_alike(n):
    assert [x.body for x in pii.nodes("x" * n + "a=12.34.56.78|b")] == ["12.34.56.78"]
    assert [x.body for x in pii.nodes("see (" + "x" * n + "/me@mail.example)")] == ["me@mail.example"]


@pytest.mark.parametrize("number", range(len(licenses.TEXTS)))
def test_whole_licenses(spark, number):
    rng = random.Random(number)
    body, label = licenses.TEXTS[number]
    lines = body.split()
    some = list(lines)
    for i in rng.sample(range(len(some)), 3):
        some[i] = "other"
    rows = [(1, words(rng, 30, 10**6) + " " + body.upper() + " " + words(rng, 30, 10**6)), (2, " ".join(some)), (3, words(rng, 200, 10**6))]
    got = {r.doc_id: r for r in licenses.report(frame(spark, rows)).collect()}
    assert got[1].labels == got[2].labels == label and got[3].labels == ""
    n = len(licenses._WORD.findall(body.lower()))
    spans = {r.doc_id: [(s.label, s.start, s.end) for s in r.found] for r in licenses.scan(frame(spark, rows)).collect()}
    assert any((a, b) == (30, 30 + n) for _, a, b in spans[1])


def test_notices_and_ends_of_lines():
    prose = "The river rose in the night and the men went down to see what it had left there.\n" + " ".join(words(random.Random(i), 12, 10**4) + "." for i in range(8))
    notices = "We use cookies to make this site better.\nAll rights reserved 2024 by the owners.\nPlease sign in to your account.\nEnable JavaScript to go on.\n"
    kept = quality.judge(prose + "\n" + notices)
    assert kept.kept and "cookies" not in kept.cleaned and "river" in kept.cleaned and "JavaScript" not in kept.cleaned
    some = prose + "\nPlease log in the logbook what item was taken out, and who took it with them that day.\nTous droits réservés.\nMehr lesen …\nAviso: política de privacidad.\n"
    kept = quality.judge(some)
    assert kept.kept and "logbook" in kept.cleaned and not any(x in kept.cleaned for x in ("droits", "Mehr", "privacidad"))
    menu = "\n".join(f"item number {words(random.Random(i), 6, 10**4)}" for i in range(20))
    assert not quality.judge(menu).kept and not quality.judge(menu).base_failed


def test_real_documents_lose_no_link(spark):
    """Of the driver's documents, every pair that brute force over shared shingles finds is in one component."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(3000).collect()]
    sets = {d: neardup.shingle_set(t or "") for d, t in rows}
    holders: dict[bytes, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared: dict[tuple[int, int], int] = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    of = {r.doc_id: r.component_id for r in neardup.report(frame(spark, rows)).collect()}
    assert len(links) > 100 and sum(of[a] == of[b] for a, b in links) >= 0.999 * len(links)
