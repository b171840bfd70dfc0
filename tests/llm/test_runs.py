"""Periodic runs against plain comparison of all words, for every lag."""

import hashlib
import os
import random
import re
import zlib

import pytest

from escriba.llm import runs

from .conftest import frame

SF = "/root/testdata/sf0.01"


def plain_words(doc_id, value):
    w = re.findall(r"[^\x20\x09-\x0D]+", value or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, value):
    w = plain_words(doc_id, value)
    found = plain_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def texts():
    rng = random.Random(1)
    for i in range(240):
        n = rng.choice([0, 1, 5, 23, 24, 30, 80, 200])
        fibonacci = ["a", "ab"]
        while len(fibonacci[-1]) < n:
            fibonacci.append(fibonacci[-1] + fibonacci[-2])
        yield i if i % 40 else None, (
            " ".join(rng.choice("ab") for _ in range(n)),
            " ".join(rng.choices("abcdefgh", k=max(1, n // 5)) * rng.randint(1, 9)),
            " \t".join(x for _ in range(4) for x in rng.choices(["foo", "bär", "baz", "l" * 20], k=rng.randint(1, 4)) * rng.randint(1, 12) + rng.choices("xy", k=rng.randint(0, 3))),
            " ".join(fibonacci[-1][:n]),
            " ".join(str(rng.randint(0, 1000)) for _ in range(n)),
            " ".join(["a"] * n + ["b"] + ["a"] * n) if i % 12 else None,
        )[i % 6]


def test_runs_of_mixed_texts(spark):
    rows = list(texts())
    got = sorted((tuple(r) for r in runs.report(frame(spark, rows)).collect()), key=str)
    want = sorted((plain_row(*r) for r in rows), key=str)
    assert got == want and sum(r[1] for r in want) > 100
    assert any(d is not None and zlib.crc32(str(d).encode()) % 10 == 0 and r for d, r in rows)


def test_edges(spark, edges, edge_rows, empty):
    got = sorted((tuple(r) for r in runs.report(edges).collect()), key=str)
    assert [r[0] for r in got] == sorted((d for d, _ in edge_rows), key=str)
    short = [(d, t) for d, t in edge_rows if len(t or "") < 80_000]
    assert [r for r in got if r[0] != 907] == sorted((plain_row(*r) for r in short), key=str)
    assert runs.report(empty).collect() == [] and runs.collapse(empty).collect() == []


def test_a_very_long_text():
    import pyarrow as pa

    rng = random.Random(3)
    block = [str(rng.randrange(10**6)) for _ in range(50_000)]
    w = [str(rng.randrange(10**6)) for _ in range(30_000)] + block * 3 + ["x"] * 1000 + [str(rng.randrange(10**6)) for _ in range(1000)]
    batch = pa.record_batch({"doc_id": pa.array([None], pa.int64()), "text": pa.array([" ".join(w)])})
    [(_, found, left)] = runs.search(batch)
    assert [(r.start, r.length, r.period) for r in found] == [(30_000, 150_000, 50_000), (180_000, 1000, 1)]
    assert left.decode().split() == w[:80_000] + ["x"] + w[181_000:]


def test_collapse_gives_texts_and_runs(spark):
    [r] = runs.collapse(frame(spark, [(None, "start " + "go on " * 20 + "end")])).collect()
    assert r.text == "start go on end" and [tuple(x) for x in r.runs] == [(1, 40, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in runs.report(docs).collect()}
    some = [r for r in rows if len(r[1] or "") < 6000]
    assert len(got) == len(rows) and len(some) > 900
    assert all(got[d] == plain_row(d, t) for d, t in some)
