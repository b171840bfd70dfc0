"""A training-data pipeline over documents: five stages, each one of the corpus operators, each on all that the one before kept.

Between stages the documents lie as Parquet files in the shared folder (storage.keep), so that each pass of a stage reads the columns that it needs; the folders stay.

Defined results, for every stage: rows are judged each for itself, repeated ones and those without a doc_id too (near-dedup keeps the latter, as they have no id to be grouped
by). Columns besides doc_id and text, whatever their names, are carried along unread; all but the last stage return the columns as they came, null texts as nulls. An empty table stays empty.
Very long texts are worked on whole. More on each is said by its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from escriba.llm import byte_bpe, decontaminate, frames, neardup, pii, toxicity
from escriba.storage import keep


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among them, scores below its threshold. Null and empty texts have no sentence and stay; without labels of both kinds all stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, frames.read(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (all rows of it). Five-word shingles, similarity of 0.8. Null and wordless texts are linked with nothing and stay."""
    return neardup.keep_first(docs, k=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Null and wordless texts have no hits and stay; with an empty benchmark all stay."""
    return decontaminate.keep_clean(docs, frames.read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked. Null texts stay null, empty ones empty."""
    return pii.redact(docs, pii.train(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with digests of them and of what they decode to. Null and empty texts have no ids, and the digests of nothing."""
    return byte_bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Stages 1, 2, 4 and 5 can't be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")  # the next stage reads its input more than once
    return docs
