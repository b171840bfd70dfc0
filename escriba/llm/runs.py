"""Periodic runs of words, found by bit-parallel lags.

Words have ids; bit b of all ids of a document is one big integer, a plane. Shifting a plane by q words and XORing it with itself shows where words q apart differ in
that bit; the OR of all planes shows where they differ at all. Long stretches without a difference are isolated by ANDing the agreements with
themselves, shifted by 1, 2, 4, ... words: what is left are the places that so many agreements follow. Each step works on a whole document at once, 64 words to a machine word.

Only lags that can hold a run are tried. A run with period q of at least 3 q words holds, for the power of two w with w / 2 < q <= w, words w in number that stand
again q words on, and, as q is its smallest period, not before that. So the distances from a place to the next of the same w words name every lag, and
they are found for all texts of a slice by doubling: places whose w words stand nowhere else in their document can't be places whose 2 w words do.

Defined results: null texts have no words. Repeated rows are answered each for itself; rows without a doc_id too, and their words stay as they are where those of a doc_id may be
made periodic. An empty table has no rows; other columns are neither read nor returned. A very long text is worked on whole, in memory of some fifty times its words;
time follows its words, times the logarithm of its length, and its words times the lags that hold repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, text

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every id as one integer, the first word at the lowest place."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def _ones(value: int) -> np.ndarray:
    """The places of the ones of an integer."""
    if not value:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(value.to_bytes((value.bit_length() + 7) // 8, "little"), np.uint8)
    some = np.flatnonzero(raw)
    at = np.flatnonzero(np.unpackbits(raw[some], bitorder="little"))
    return some[at // 8] * 8 + at % 8


def stretches(ids_planes: list[int], n: int, lag: int) -> list[tuple[int, int]]:
    """(first word, end) of every longest stretch in which words lag apart are the same, of as many words as a run of that period needs."""
    least = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag  # agreements
    if n - lag < least:
        return []
    differs = 0
    for p in ids_planes:
        differs |= p ^ (p >> lag)
    left = ((1 << (n - lag)) - 1) & ~differs
    have = 1
    while have < least and left:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if not left:
        return []
    firsts, lasts = _ones(left & ~(left << 1)), _ones(left & ~(left >> 1))
    return [(int(a), int(b) + least + lag) for a, b in zip(firsts, lasts, strict=True)]


def runs_of(ids: np.ndarray, lags: list[int]) -> list[Run]:
    """The runs among words with these ids, by start, then period; lags: all that can be periods, ascending."""
    if not lags:
        return []
    n, known = len(ids), planes(ids)
    found: dict[tuple[int, int], int] = {}
    for q in lags:
        for span in stretches(known, n, q):
            # three periods long: a smaller period divides q, and its run is this very stretch
            found.setdefault(span, q)
    return sorted(Run(a, q, b - a) for (a, b), q in found.items())


def lags_of(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """For each document, the lags that may be periods of its runs. ids: of the words of all documents in turn, first: where each document begins, and the end."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(first[1:], counts)
    at = np.flatnonzero(np.repeat(counts >= LEAST_WORDS, counts))  # places that are looked at
    name = ids.astype(np.int64)  # of the w words from each place on; the same only for the same words
    keys: list[np.ndarray] = []
    w, top = 1, int(counts.max(initial=0)) + 1
    while len(at):
        # places of the same words of one document, in order; doc and name fit one number, as there are fewer names than places
        order = at[np.argsort(doc[at] * np.int64(len(ids) + 1) + name[at], kind="stable")]
        again = (doc[order[1:]] == doc[order[:-1]]) & (name[order[1:]] == name[order[:-1]])
        distance = (order[1:] - order[:-1])[again]
        here = order[1:][again]
        fits = (distance > w // 2) & (distance <= w)
        keys.append(np.unique(doc[here[fits]] * np.int64(top) + distance[fits]))
        shared = np.zeros(len(order), bool)
        shared[1:] |= again
        shared[:-1] |= again
        # names for twice as many words, at places whose w words stand elsewhere too, as do the w words after them, and that a run of longer period has room for
        keep = np.zeros(len(ids) + w, bool)
        keep[order[shared]] = True
        at = np.flatnonzero(keep[: len(ids)])
        at = at[(at + 2 * w <= end[at]) & keep[at + w] & (counts[doc[at]] >= LEAST_PERIODS * (w + 1))]
        if len(at):
            pair = name[at] * np.int64(len(ids) + 1) + name[at + w]
            name = name.copy()
            name[at] = np.unique(pair, return_inverse=True)[1]
        w *= 2
    out: list[list[int]] = [[] for _ in counts]
    for key in np.unique(np.concatenate(keys)).tolist() if keys else []:
        out[key // top].append(key % top)
    return out


def made_periodic(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where words from a on repeat the p words there, for a tenth of all doc_ids; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def greatest(runs: list[Run]) -> Run | None:
    """The run of the greatest length in periods; of equals the first, then that of the smaller period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which words some run repeats: all of it but its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge)[:n] > 0


def search(part: pa.RecordBatch) -> Iterator[tuple[int | None, list[Run], bytes]]:
    """For every row (doc_id, text) its doc_id, runs, and the kept words, joined by spaces."""
    raw, offsets = text.utf8(part.column(1))
    words = text.Words(raw, offsets, text.SPACE_WORDS, lower=False)
    one, two = text.fingerprints(text.eights(words.bytes), words.start, words.end, check=True)
    # words are the same only if both numbers are
    ids = np.unique(one, return_inverse=True)[1]
    seconds = np.unique(two, return_inverse=True)[1]
    ids = np.unique(ids * np.int64(len(ids) + 1) + seconds, return_inverse=True)[1]
    doc_ids = part.column(0).to_pylist()
    places = np.arange(len(ids))
    for i, doc_id in enumerate(doc_ids):
        made = made_periodic(doc_id, int(words.count[i]))
        if made is not None:
            a, p = words.first[i] + made[0], made[1]
            places[a : words.first[i + 1]] = a + np.arange(words.first[i + 1] - a) % p
    ids = ids[places]
    lags = lags_of(ids, words.first)
    for i, doc_id in enumerate(doc_ids):
        a, b = words.first[i], words.first[i + 1]
        runs = runs_of(ids[a:b], lags[i])
        whole = raw[offsets[i] : offsets[i + 1]].tobytes().split()  # at the same characters
        own = places[a:b] - a
        if runs:
            own = own[~dropped(runs, len(own))]
        if len(own) < len(whole) or (own != np.arange(len(own))).any():
            whole = [whole[j] for j in own.tolist()]
        yield doc_id, runs, b" ".join(whole)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text without what its runs repeat, and its runs (start, length, period: words, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                found = list(search(part))
                yield pa.record_batch({"doc_id": part.column(0), "text": pa.array([x.decode() for _, _, x in found], pa.string()), "runs": pa.array([[{"start": r.start, "length": r.length, "period": r.period} for r in runs] for _, runs, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))})

    return frames.doc_texts(docs).mapInArrow(run, "doc_id long, text string, runs array<struct<start: bigint, length: bigint, period: bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """Per document: how many runs it has, the one of most periods, and digests of all runs and of the words that are left without their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                rows = []
                for doc_id, runs, left in search(part):
                    best = greatest(runs)
                    said = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
                    shown = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
                    rows.append((doc_id, len(runs), *shown, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return frames.doc_texts(docs).mapInArrow(run, SCHEMA)
