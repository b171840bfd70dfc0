"""Benchmark decontamination: an FM-index per training shard, searched backwards for every test phrase.

Each shard (consecutive documents, at most SHARD_WORDS words; a longer document is cut into pieces that overlap by a
window less one word) is indexed once, in the task that read it. Every window of every benchmark item is searched through
wavelet-tree ranks, its occurrences are located by sampled suffix positions, compared word by word (hashes first, then the bytes), and merged
into removal spans. Documents are read once and nothing is shuffled; only spans and counts leave a task. A large benchmark is sent in
blocks of BLOCK_BYTES; a task indexes a few slices of its texts, searches all of them for one block after another, and holds one block at a time.

Rules: text lower-cased in A-Z; words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a window is `width` consecutive words of an
item, an item of fewer words is one window, one without words has none. Null or wordless documents have no hits. Items
with equal text count each for itself, but rows of one item_id are one item; a null item_id is written as an empty one. Rows of documents are answered
each for itself, repeated ones and those without a doc_id too. Empty tables: no documents, no rows; no benchmark, no hits. Other columns,
whatever their names, are not read; keep_clean returns them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text
from .fm_index import MOST, FMIndex, symbols

WIDTH = 13
SHARD_WORDS = 400_000
#: Benchmark texts of more bytes than this go in several blocks.
BLOCK_BYTES = 2 << 20

#: Slices that a task has indexed when it reads the blocks.
AT_ONCE = 4

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Phrases:
    """Distinct windows of the items of a block. groups, by length: the windows' symbols, the place of each one's first word in words, its number."""

    names: list[str]
    words: text.Words
    hashes: np.ndarray
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    #: of each number, where its items (as indices) begin in owners
    owner_first: np.ndarray
    owners: np.ndarray


def same_words(x: text.Words, at: np.ndarray, y: text.Words, other: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words of x from each place on are those of y from the other place on."""
    same = np.ones(len(at), dtype=bool)
    for j in range(n):
        a, b = at[same] + j, other[same] + j
        same[same] = text.same_bytes(x.bytes, x.start[a], x.end[a], y.bytes, y.start[b], y.end[b])
    return same


def phrases(items: list[tuple[str, str]], width: int = WIDTH) -> Phrases:
    words = text.Words(*text.utf8(pa.array([t or "" for _, t in items], pa.string())), text.ALNUM_WORDS)
    hashes = words.hashes()
    length = np.minimum(words.count, width)
    groups, pairs, number = [], [np.zeros((0, 2), dtype=np.int64)], 0
    for n in np.unique(length[length > 0]).tolist():
        items_of = np.flatnonzero(length == n)
        many = words.count[items_of] - n + 1
        at = text.ragged(words.first[items_of], many)
        _, first, which = np.unique(text.windows(hashes, n)[at], return_index=True, return_inverse=True)
        own = at[first]
        # windows of one hash and other words are windows of their own
        odd: dict[tuple[bytes, ...], int] = {}
        for i in np.flatnonzero(~same_words(words, at, words, own[which], n)).tolist():
            key = tuple(words.word(int(at[i]) + j) for j in range(n))
            if key not in odd:
                odd[key] = len(own)
                own = np.append(own, at[i])
            which[i] = odd[key]
        groups.append((n, symbols(hashes[own[:, None] + np.arange(n)]), own, np.arange(number, number + len(own))))
        pairs.append(np.stack([which + number, np.repeat(items_of, many)], axis=1))
        number += len(own)
    words.forget()
    every = np.unique(np.concatenate(pairs), axis=0)
    return Phrases([name for name, _ in items], words, hashes, groups, np.searchsorted(every[:, 0], np.arange(number + 1)), every[:, 1])


class Shard:
    """An FM-index over consecutive words of many documents, with a separator after each document's last word."""

    def __init__(self, words: text.Words, hashes: np.ndarray, begin: int, end: int):
        self.words, self.hashes, self.begin = words, hashes, begin
        doc = words.doc[begin:end]
        shift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
        stream = np.zeros(len(doc) + int(shift[-1]) + 1, dtype=np.uint8)
        place = np.arange(len(doc)) + shift
        stream[place] = symbols(hashes[begin:end])
        self.back = np.full(len(stream), -1, dtype=np.int64)
        self.back[place] = np.arange(len(doc))
        self.index = FMIndex(stream)

    def occurrences(self, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, length and number of every occurrence of a window within a document."""
        starts, lengths, numbers = [], [], []
        for n, pattern, first, number in wanted.groups:
            low, high = self.index.search(pattern)
            hit = np.flatnonzero(high > low)
            many = high[hit] - low[hit]
            each = max(1, (1 << 21) // max(1, n))
            ends = np.cumsum(many)
            done = 0
            while done < len(hit):  # so many occurrences at a time
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + each, "right")))
                which = np.repeat(hit[done:to], many[done:to])
                at = self.back[self.index.locate(text.ragged(low[hit[done:to]], many[done:to]))] + self.begin
                # equal symbols are a candidate, equal hashes a better one, equal words an occurrence
                same = np.ones(len(at), dtype=bool)
                for j in range(n):
                    same[same] = self.hashes[at[same] + j] == wanted.hashes[first[which[same]] + j]
                same[same] = same_words(self.words, at[same], wanted.words, first[which[same]], n)
                starts.append(at[same])
                lengths.append(np.full(int(same.sum()), n))
                numbers.append(number[which[same]])
                done = to
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *x]) for x in (starts, lengths, numbers))  # type: ignore[return-value]


def shard_of(counts: np.ndarray, width: int) -> list[list[tuple[int, int, int]]]:
    """Shards as lists of (document, first word, end word): whole documents together, long ones alone in overlapping pieces."""
    out: list[list[tuple[int, int, int]]] = [[]]
    room = SHARD_WORDS
    most = MOST // 2
    for i, n in enumerate(counts.tolist()):
        if n > most:
            out += [[(i, a, min(n, a + most))] for a in range(0, n - width + 1, most - width + 1)]
            out.append([])
            room = SHARD_WORDS
            continue
        if n > room and out[-1]:
            out.append([])
            room = SHARD_WORDS
        if n:
            out[-1].append((i, 0, n))
            room -= n
    return [x for x in out if x]


class Scan:
    """The texts of a slice, indexed, and what was found in them so far."""

    def __init__(self, column: pa.Array, width: int = WIDTH):
        self.words = text.Words(*text.utf8(column), text.ALNUM_WORDS)
        hashes = self.words.hashes()
        self.words.forget()
        # the pieces of a shard lie next to each other but for wordless documents between them
        first = self.words.first
        self.shards = [Shard(self.words, hashes, int(first[x[0][0]]) + x[0][1], int(first[x[-1][0]]) + x[-1][2]) for x in shard_of(self.words.count, width)]
        self.change = np.zeros(len(self.words) + 1, dtype=np.int64)
        self.items: list[set[str]] = [set() for _ in range(len(column))]

    def look(self, wanted: Phrases) -> None:
        for shard in self.shards:
            at, length, number = shard.occurrences(wanted)
            # +1 at a start, -1 at an end; windows don't cross documents
            np.add.at(self.change, at, 1)
            np.add.at(self.change, at + length, -1)
            for d, w in np.unique(np.stack([self.words.doc[at], number], axis=1), axis=0).tolist() if len(at) else ():
                self.items[d].update(wanted.names[i] for i in wanted.owners[wanted.owner_first[w] : wanted.owner_first[w + 1]].tolist())

    def found(self) -> tuple[np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
        """For each text: number of words, sorted names of items with an occurring window, merged spans of hit words."""
        words = self.words
        hit = np.cumsum(self.change)[:-1] > 0
        edge = np.ones(len(words), dtype=bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (words.doc[1:] != words.doc[:-1])
        cut = np.flatnonzero(edge)
        stop = np.append(cut[1:], len(words))[: len(cut)]
        spans: list[list[tuple[int, int]]] = [[] for _ in self.items]
        for s, e in zip(cut[hit[cut]].tolist(), stop[hit[cut]].tolist(), strict=True):
            d = int(words.doc[s])
            spans[d].append((s - int(words.first[d]), e - int(words.first[d])))
        return words.count, [sorted(x) for x in self.items], spans


def scan(column: pa.Array, every: Iterable[Phrases], width: int = WIDTH) -> tuple[np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """Scan.found() of some texts. every: the blocks of the benchmark, each asked for once."""
    one = Scan(column, width)
    for wanted in every if one.shards else ():
        one.look(wanted)
    return one.found()


def blocks(benchmark: DataFrame, most: int | None = None) -> Iterator[list[tuple[str, str]]]:
    """The items (id as string, text), in blocks of at most so many bytes (BLOCK_BYTES; one longer item is a block), one at a time on the driver."""
    most = most or BLOCK_BYTES
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block, room = [], most
    for item, words in rows.orderBy("item_id").toLocalIterator():
        size = len(words.encode())
        if block and size > room:
            yield block
            block, room = [], most
        block.append((item, words))
        room -= size
    if block:
        yield block


def _shared(benchmark: DataFrame, width: int) -> list:
    """A broadcast for each block: each is bounded, and an executor keeps them on disk where memory is short."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(phrases(block, width)) for block in blocks(benchmark)]


def _one_at_a_time(shared: list) -> Iterator[Phrases]:
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)  # the worker reads it again for its next texts


def _searched(slices: Iterator[tuple], shared: list, width: int) -> Iterator[tuple]:
    """Of slices of rows (a batch and its texts) the batch and what Scan found. AT_ONCE slices are indexed, and then each block is read once for all of them."""
    while some := [(rows, Scan(texts, width)) for rows, texts in islice(slices, AT_ONCE)]:
        for wanted in _one_at_a_time(shared) if any(x.shards for _, x in some) else ():
            for _, x in some:
                x.look(wanted)
        for rows, x in some:
            yield rows, *x.found()


def find_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, items (ids as strings, sorted) and merged spans of hit words (end exclusive), a row per row of docs."""
    shared = _shared(benchmark, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((part, part.column(1)) for batch in batches for part in text.slices(batch))
        for part, n, items, spans in _searched(parts, shared, width):
            found = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], SPANS)
            yield pa.record_batch({"doc_id": part.column(0), "n_words": pa.array(n, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": found})

    return frames.doc_texts(docs).mapInArrow(run, "doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated (any hit, and hit words are at least a twentieth)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (
        find_spans(docs, benchmark, width)
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "spans")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns, whose text isn't contaminated by the report's rule."""
    shared = _shared(benchmark, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in text.rows_with_text(batch))
        for rows, n, _, spans in _searched(parts, shared, width):
            hit = np.array([sum(e - s for s, e in x) for x in spans], dtype=np.int64)
            yield rows.filter(pa.array((hit == 0) | (20 * hit < n)))

    return docs.mapInArrow(run, docs.schema)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = WIDTH) -> list[tuple]:
    """The report by plain comparison, for tests."""
    import re

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    wanted: dict[tuple[str, ...], set[str]] = {}
    for name, t in items:
        w = words(t)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[j : j + n]), set()).add(name)
    sizes = {len(w) for w in wanted}
    out = []
    for doc_id, t in docs:
        w = words(t)
        hit, own = [False] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[j : j + n])):
                    own |= found
                    hit[j : j + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[j : j + least(13, len(w)) - 1], ' ') as win from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as j from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, j, n, array_to_string(w[j : j + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as j from d, sizes where len(w) >= n)),
m as (select doc_id, j, n, item_id from dw join bw using (n, win)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j + n)) as p from m) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits on d.doc_id = hits.doc_id left join its on d.doc_id = its.doc_id
"""
