import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from escriba.llm import byte_bpe, decontaminate, neardup, queries

from .conftest import words


def tables(spark, folder):
    rng = random.Random(7)
    phrase = " ".join(f"q{i}" for i in range(14))
    docs, labels = [], []
    for i in range(400):
        t = words(rng, 40, 10**5) + "."
        if i % 8 == 0:
            t += f" {rng.choice(['vile', 'rotten'])} thing."
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 8 == 0)))
    for i in range(400, 420):  # copies and near copies
        t = docs[i - 399][1] + ("" if i % 2 else " more")
        docs.append((i, t, "en", "s0", len(t)))
    docs += [(500, phrase, "en", "s1", len(phrase)), (501, "write to me.2@mail.example.com now, please do", "en", "s1", 0), (502, None, None, None, None), (503, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/stage{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.collect()})
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            assert kept[1] == {d for d, _, _, good in neardup.brute_force(before, 5) if good}
        if i == 2:
            assert kept[2] == {r[0] for r in decontaminate.brute_force(before, [("1", " ".join(f"q{j}" for j in range(14)))]) if not r[-1]}
        if i == 3:
            text = {r.doc_id: r.text for r in docs.collect()}
            assert text[501] == "write to [EMAIL] now, please do" and text[502] is None
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(kept[0] & toxic) <= 2 and len(set(range(400)) - toxic - kept[0]) <= 2
    assert 500 not in kept[2] and {501, 502, 503} <= kept[4]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in docs.collect():
        assert r.ids == enc.encode_ordinary(text[r.doc_id] or "")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
