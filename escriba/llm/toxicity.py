"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is logistic in its words' features (the word, its first 4, 5
and 6 bytes, its last 4 bytes, each hashed into 2^20 buckets); a document's is 1 - product(1 - sentence). Only the
document's label is known in training, so the gradient of the noisy-or itself decides which sentences are to blame;
the same sentence scores then locate the offending sentences.

Training takes a sample of labelled rows whose size is a parameter (MOST_TOXIC, MOST_CLEAN: those with the smallest
hashes of doc_id, and MOST_CHARS: as many of them as have so many characters together). Features are selected by their document frequencies, counted on the executors; the driver gets at
most MOST_FEATURES features and the sample's sentences as lists of them. Scoring reads every whole text once.

Defined results: null or empty text has no sentence and scores 0; without labels of both kinds every text scores 0;
labels that are null, or of unknown documents, are ignored; of several labels of a document the largest counts; repeated
rows of documents are scored each for itself, with or without a doc_id (without one, held_out is null). Columns lang, source and labels are
never inputs of a score. An empty table has no rows; keep_clean returns all columns, whatever their names, as they are, and keeps texts without words. A very long text is scored whole, as a slice by itself; no sentence or word of it is left out, and MOST_CHARS keeps it from
filling the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, text

THRESHOLD = 0.3
MOST_TOXIC, MOST_CLEAN = 2_000, 6_000
#: Characters of all sampled texts together; one that would lead beyond is left out.
MOST_CHARS = 64 << 20
MOST_FEATURES = 20_000
#: A feature is kept if it is in so many sampled documents, and its rates in the two classes differ by so many standard errors.
LEAST_DOCS, LEAST_Z = 3, 4.5
BUCKETS = 1 << 20
KINDS = 5

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    """weights: one of each bucket; bias: the logit of a sentence without known features; empty: nothing was learned."""

    weights: np.ndarray
    bias: float
    empty: bool = False


@dataclass
class Sentences:
    """Of a slice of documents. features: KINDS buckets of each word; of: sentence of each word; doc, start, end: of each sentence (code points)."""

    features: np.ndarray
    of: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int


def sentences(column: pa.Array) -> Sentences:
    raw, offsets = text.utf8(column)
    words = text.Words(raw, offsets, text.ALNUM_WORDS)
    kinds = [words.hashes(), *(words.prefix_hashes(n) for n in (4, 5, 6))]
    tail = np.zeros(len(words), dtype=np.uint64)
    for j in range(1, 5):
        at = words.end - j
        tail = tail * np.uint64(256) + np.where(at >= words.start, words.bytes[np.maximum(at, 0)], 0).astype(np.uint64)
    kinds.append(text.mix(tail + np.uint64(1)))
    features = np.stack([(text.mix(h + np.uint64(k)) >> np.uint64(44)).astype(np.int32) for k, h in enumerate(kinds)], axis=1)
    breaks = np.cumsum(_END[raw])
    number = (breaks[words.start] if len(words) else np.zeros(0, np.int64)) + words.doc  # a document's end is a break too
    new = np.ones(len(words), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    of = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(words))[: len(first)] - 1
    points = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    doc = words.doc[first]
    base = points[offsets[doc]] if len(first) else np.zeros(0, np.int64)
    return Sentences(features, of, doc, points[words.start[first]] - base, points[words.end[last]] - base, len(offsets) - 1)


def logits(s: Sentences, model: Model) -> np.ndarray:
    return model.bias + np.bincount(s.of, weights=model.weights[s.features].sum(axis=1), minlength=len(s.doc))


def noisy_or(z: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """1 - product(1 - sigmoid(z)) of each document's sentences; 0 for one without any."""
    return -np.expm1(-np.bincount(doc, weights=np.logaddexp(0, z), minlength=n_docs))


def fit(features: np.ndarray, of: np.ndarray, doc: np.ndarray, labels: np.ndarray, start: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss of the noisy-or. features, of: index and sentence of every feature; doc: of every sentence; start: first weights."""
    weights, bias = start.copy(), -8.0
    m = np.zeros(len(weights) + 1)
    v = np.zeros(len(weights) + 1)
    n = max(1, len(labels))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(of, weights=weights[features], minlength=len(doc))
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)  # -log(1 - P)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        blame = np.where(labels == 1, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0)
        dz = blame[doc] * p / n
        g = np.append(np.bincount(features, weights=dz[of], minlength=len(weights)) + l2 * weights / n, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(most_clean))
    # rows of one doc_id are one example: the greatest text of them
    sample = frames.cut(frames.doc_texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", "text", "toxic"))
    room, out = MOST_CHARS, []
    for doc_id, n in sample.select("doc_id", F.length("text")).orderBy(*order).collect():  # most_toxic + most_clean rows at most
        if n > room:
            out.append(doc_id)
        else:
            room -= n
    return sample.where(~F.col("doc_id").isin(out)) if out else sample


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model from at most so many labelled documents of each kind. Held-out rows are never among them."""
    sample = _sample(docs, labels, most_toxic, most_clean)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model(np.zeros(BUCKETS, dtype=np.float32), -40.0, True)
    if not pos or not neg:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                s = sentences(part.column(1))
                toxic = part.column(2).to_numpy(zero_copy_only=False)
                key = np.unique((s.doc[s.of].astype(np.int64)[:, None] * BUCKETS + s.features).ravel())
                bucket, of = key % BUCKETS, key // BUCKETS
                for label, name in ((1, "pos"), (0, "neg")):
                    values, n = np.unique(bucket[toxic[of] == label], return_counts=True)
                    yield pa.record_batch({"feature": values.astype(np.int32), "pos": (n * (name == "pos")).astype(np.int64), "neg": (n * (name == "neg")).astype(np.int64)})

    total, rate = pos + neg, (F.col("pos") + F.col("neg")) / F.lit(float(pos + neg))
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1.0 / pos + 1.0 / neg))
    counted = sample.mapInArrow(count, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(f"pos + neg >= {LEAST_DOCS} and pos + neg < {total}").withColumn("z", z).where(F.abs("z") >= LEAST_Z)
    kept = counted.orderBy(F.abs("z").desc(), "feature").limit(MOST_FEATURES).toPandas()
    if not len(kept):
        return nothing
    buckets = kept["feature"].to_numpy()
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[buckets] = np.arange(len(buckets))
    shared = sample.sparkSession.sparkContext.broadcast(number)  # BUCKETS integers

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                s = sentences(part.column(1))
                known = shared.value[s.features]
                row, column = np.nonzero(known >= 0)
                of, feature = s.of[row], known[row, column]
                full = np.zeros(len(s.doc), dtype=bool)
                full[of] = True
                bare = np.bincount(s.doc[~full], minlength=s.n_docs)  # sentences without any known feature: only their number matters
                where = s.doc[of]
                cut = np.searchsorted(where, np.arange(s.n_docs + 1))
                yield pa.record_batch({"toxic": part.column(2), "bare": bare.astype(np.int64), "sentence": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(of.astype(np.int32))), "feature": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature.astype(np.int32)))})

    rows = sample.orderBy("doc_id").mapInArrow(lists, "toxic int, bare long, sentence array<int>, feature array<int>").toPandas()
    feature, of, doc, n_sentences = [], [], [], 0
    for i, (bare, sentence, known) in enumerate(zip(rows["bare"], rows["sentence"], rows["feature"], strict=True)):
        own, local = np.unique(np.asarray(sentence, dtype=np.int64), return_inverse=True)
        feature.append(np.asarray(known, dtype=np.int64))
        of.append(local.astype(np.int64) + n_sentences)
        n = len(own) + int(bare)
        doc.append(np.full(n, i))
        n_sentences += n
    start = np.clip(0.25 * np.log(((kept["pos"] + 0.5) / (pos + 1)) / ((kept["neg"] + 0.5) / (neg + 1))).to_numpy(), -2, 2)
    weights, bias = fit(np.concatenate(feature), np.concatenate(of), np.concatenate(doc), rows["toxic"].to_numpy(), start)
    table = np.zeros(BUCKETS, dtype=np.float32)
    table[buckets] = weights
    return Model(table, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, n_sentences, offending: array of struct(start, end, score), the sentences with a score of at least threshold (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text.slices(batch):
                s = sentences(part.column(1))
                z = np.full(len(s.doc), -np.inf) if m.empty else logits(s, m)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                found: list[list[dict]] = [[] for _ in range(s.n_docs)]
                for i in np.flatnonzero(p >= threshold).tolist():
                    found[s.doc[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "score": float(p[i])})
                total = np.zeros(s.n_docs) if m.empty else noisy_or(z, s.doc, s.n_docs)
                yield pa.record_batch({"doc_id": part.column(0), "score": total, "n_sentences": np.bincount(s.doc, minlength=s.n_docs).astype(np.int64), "offending": pa.array(found, pa.list_(span))})

    return frames.doc_texts(docs).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted (1 from THRESHOLD on), n_sentences, and the offending sentences as start:end."""
    scored = score(docs, train(docs, labels))
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", spans.alias("offending"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, texts in text.rows_with_text(batch):
                s = sentences(texts)
                good = np.ones(s.n_docs, dtype=bool) if m.empty else noisy_or(logits(s, m), s.doc, s.n_docs) < threshold
                yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
