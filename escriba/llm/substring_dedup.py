"""Substring dedup by sliding spans of words.

Sentences end at . ! ? or a line feed. Three kinds of spans are hashed (128 bits of their words, lower-cased in A-Z, so that
neither spacing nor line breaks matter):
(1) from every sentence the shortest run of at least RUN consecutive sentences with at least LEAST_WORDS words (a long run of
short sentences where that is needed);
(2) every sentence of at least LEAST_WORDS words by itself;
(3) pieces of PIECE_WORDS words, wherever they begin: of every SURE_WORDS consecutive words that hold no whole span of the first two
kinds, the piece at the least hash of four words (winnowing). Which piece that is follows from those words alone, so every
copy of them has the same one.
A passage of SURE_WORDS words or more that occurs again thus shares a span wherever it begins and ends, within sentences too
and without any sentences; a shorter one is found if it holds a span. SURE_WORDS = 2 PIECE_WORDS - 1, so in a long passage
without sentences the pieces leave no gap.

Spans are joined globally; of every hash that occurs twice or more, the occurrence with the least (doc_id, mark of the text, word) stays,
and the words that any other occurrence covers are removed. What a task can decide alone it does: of CHUNK spans, an occurrence after another
of the same hash is removed whatever stands elsewhere, so each hash is shuffled once for each chunk at most, however often it
occurs. One exchange by hash then ranks what is left.

What is removed are whole spans: at each end of a passage, the words before its first and after its last span stay (of a
passage without sentences at most PIECE_WORDS - 1 at each end). Defined results: null or empty texts have no sentences and stay as they are;
a document whose every sentence repeats an earlier one becomes empty; repeats within one document count too; a last span
of a document may be shorter than RUN sentences only if a document has fewer. A text is known by doc_id and a hash of it (mark): rows of one
doc_id and text count once and are answered each for itself, other texts of that doc_id are documents of their own. Rows without a
doc_id lose nothing, and what others share with them doesn't count. An empty table has no rows; other columns are neither read nor returned. A very long text is a slice by itself, its
spans some forty bytes for each sentence or piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, text

RUN = 2
LEAST_WORDS = 24
SURE_WORDS, PIECE_WORDS = 51, 26
#: Spans that a task compares among themselves before it sends them off.
CHUNK = 1 << 20

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, text.Words]:
    """Word boundaries and sentences of many texts: first word of each sentence, their start bytes, first sentence of each document, words."""
    words = text.Words(raw, offsets, text.SPACE_WORDS)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), words
    ends = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_END[raw], out=ends[1:])
    # a sentence begins with a document's first word, and with a word after one that holds a terminator at its end or before a line feed
    gap = np.zeros(len(words), dtype=bool)
    gap[0] = True
    last_byte = raw[words.end[:-1] - 1]
    gap[1:] = _END[last_byte] | (ends[words.start[1:]] > ends[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
    first_word = np.flatnonzero(gap)
    first_sentence = np.searchsorted(first_word, words.first, "left")
    return first_word, words.start[first_word], first_sentence, words


def pieces(h: np.ndarray, last: np.ndarray, first_word: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First words of the pieces. h, last: hash of every word and end of its document; first_word, ends: of every sentence its first word, and the end of its shortest span."""
    s = np.flatnonzero(np.arange(len(h)) + SURE_WORDS <= last)
    # a window's own words tell that a sentence begins at any of them but the first
    soonest = np.append(np.minimum.accumulate(ends[::-1])[::-1], len(h) + SURE_WORDS)
    s = s[soonest[np.searchsorted(first_word, s + 1, "left")] >= s + SURE_WORDS]
    if not len(s):
        return s
    value = np.full(len(h), np.iinfo(np.uint64).max)
    value[: len(h) - 3] = text.windows(h, 4)
    # the first least value of every width positions, by doubling
    at, width = np.arange(len(h)), 1
    while width < SURE_WORDS - PIECE_WORDS + 1:
        step = min(width, SURE_WORDS - PIECE_WORDS + 1 - width)
        other = at[step:]
        at = np.where(value[at[: len(other)]] <= value[other], at[: len(other)], other)
        width += step
    return np.unique(at[s])


def spans(raw: np.ndarray, offsets: np.ndarray, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, first word (within it), number of words, and two hashes of every span."""
    first_word, _, first_sentence, words = split(raw, offsets)
    n = len(first_word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first_sentence))
    stop = first_sentence[1:][doc]  # the document's last sentence + 1
    starts = np.append(first_word, len(words))
    enough = np.searchsorted(starts, first_word + least_words, "left")
    end = np.maximum(np.arange(n) + run, enough)
    valid = end <= stop
    whole = np.arange(n) == first_sentence[:-1][doc]
    short = whole & ~valid  # too short a document: its whole text is the one span
    end = np.where(short, stop, end)
    valid |= short
    alone = (enough <= stop) & (enough < end)
    h, other = text.fingerprints(text.eights(words.bytes), words.start, words.end, check=True)
    ends = np.where(enough <= stop, starts[np.minimum(enough, n)], len(words) + SURE_WORDS)
    piece = pieces(h, words.first[1:][words.doc], first_word, ends)
    a = np.concatenate([first_word[valid], first_word[alone], piece])
    b = np.concatenate([starts[end[valid]], ends[alone], piece + PIECE_WORDS])
    # words of a span, hashed in order: weights depend on the distance from the span's first word
    idx = text.ragged(a, b - a)
    place = (idx - np.repeat(a, b - a)).astype(np.uint64)
    bounds = np.append(0, np.cumsum(b - a))[:-1]
    one = np.add.reduceat(text.mix(h[idx] + place * np.uint64(0x9E3779B97F4A7C15)), bounds)
    # words whose first numbers clash differ in the second
    two = np.add.reduceat(text.mix((other[idx] ^ np.uint64(0x5851F42D4C957F2D)) + place * np.uint64(0xD1342543DE82EF95)), bounds)
    return words.doc[a], a - words.first[words.doc[a]], b - a, one, two


def _merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words of documents, with those that overlap or touch made one."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + n)[order]
    # ends as far as any range of the document has come: documents are set apart by more than any text is long
    far = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(far + end)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (far + at)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], at[first], (reach - far)[last] - at[first]


class _Chunk:
    """Spans of many slices of documents, decided among themselves."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.size = 0

    def add(self, ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self.ids.append(ids)
        self.marks.append(marks)
        self.parts.append((doc + self.docs, at.astype(np.int64), n.astype(np.int64), one, two))
        self.docs += len(ids)
        self.size += len(doc)

    def rows(self) -> pa.RecordBatch:
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        doc, at, n, one, two = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        order = np.argsort(one, kind="stable")
        same = one[order][1:] == one[order][:-1]
        shared = np.zeros(len(one), dtype=bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        many = np.flatnonzero(shared)
        many = many[np.lexsort((at[many], marks[doc[many]], ids[doc[many]], two[many], one[many]))]
        hash_new, place_new = np.ones(len(many), dtype=bool), np.ones(len(many), dtype=bool)
        hash_new[1:] = (one[many][1:] != one[many][:-1]) | (two[many][1:] != two[many][:-1])
        d = doc[many]
        place_new[1:] = hash_new[1:] | (ids[d][1:] != ids[d][:-1]) | (marks[d][1:] != marks[d][:-1]) | (at[many][1:] != at[many][:-1])
        # a hash's first place, by whichever of its equal rows; rows at that place again are the same occurrence
        group = np.cumsum(hash_new) - 1
        begin = np.flatnonzero(hash_new)
        at_first = np.cumsum(place_new)[begin][group] == np.cumsum(place_new) if len(many) else np.zeros(0, bool)
        keep = np.sort(np.concatenate([np.flatnonzero(~shared), many[hash_new]]))
        a_doc, a_at, a_n = _merged(doc[many[~at_first]], at[many[~at_first]], n[many[~at_first]])
        every = lambda first, second: np.concatenate([first, second])
        all_doc, all_at, all_n = every(doc[keep], a_doc), every(at[keep], a_at), every(n[keep], a_n)
        # decided ranges have no hash: they are dealt by where they stand
        spread = text.mix((marks[a_doc].view(np.uint64) ^ text.mix(ids[a_doc].view(np.uint64))) + a_at.astype(np.uint64))
        return pa.record_batch({"doc_id": ids[all_doc], "mark": marks[all_doc], "at": all_at.astype(np.int32), "n": all_n.astype(np.int32), "h1": text.signed(every(one[keep], spread)), "h2": text.signed(every(two[keep], np.zeros(len(a_doc), np.uint64))), "again": np.arange(len(all_doc)) >= len(keep)})


def marked(docs: DataFrame) -> DataFrame:
    return frames.doc_texts(docs).withColumn("mark", F.xxhash64("text"))


def span_table(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, mark, at, n and two hashes of spans, each hash once for each chunk; and ranges of words (again) that repeat others of their chunk."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Chunk()
        for batch in batches:
            for part in text.slices(batch):
                now.add(part.column(0).to_numpy(), part.column(2).to_numpy(), *spans(*text.utf8(part.column(1)), run, least_words))
                if now.size >= chunk:
                    yield now.rows()
        if now.size:
            yield now.rows()

    return marked(docs).where("doc_id is not null").mapInArrow(f, "doc_id long, mark long, at int, n int, h1 long, h2 long, again boolean")


def repeated(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, mark, array of struct(at, n): the ranges of words of each text that repeat earlier ones."""
    # a hash has a row for each chunk that holds it at most
    place = F.dense_rank().over(Window.partitionBy("h1", "h2", "again").orderBy("doc_id", "mark", "at"))
    later = span_table(docs, run, least_words, chunk).withColumn("place", place).where("again or place > 1")
    return later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))


def remove(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text (without the removed words), n_sentences, n_removed (sentences that lost any word), removed: merged ranges of words as at:end."""
    found = frames.cut(repeated(docs, run, least_words, chunk))
    joined = marked(docs).join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                raw, offsets = text.utf8(part.column(1))
                first_word, _, first, words = split(raw, offsets)
                own = part.column(2)
                at = np.repeat(words.first[:-1], np.diff(own.offsets.to_numpy()))
                lo, hi = own.offsets[0].as_py(), own.offsets[len(own)].as_py()
                at = at + own.values.field("at").to_numpy(zero_copy_only=False)[lo:hi]
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + own.values.field("n").to_numpy(zero_copy_only=False)[lo:hi], -1)
                dropped = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
                hit = np.maximum.reduceat(dropped, first_word) if len(first_word) else dropped
                out, many, gone, ranges = [], [], [], []
                for i in range(part.num_rows):
                    body = raw[offsets[i] : offsets[i + 1]]
                    begin, end = int(words.first[i]), int(words.first[i + 1])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], dropped[begin:end], [0]])))
                    pairs = list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
                    if pairs:
                        # a word reaches to the next one's first byte; what stands before the first word stays
                        cuts = np.append(words.start[begin:end] - offsets[i], len(body))
                        keep = np.ones(len(body), dtype=bool)
                        for a, b in pairs:
                            keep[cuts[a] : cuts[b]] = False
                        body = body[keep]
                    out.append(body.tobytes())
                    many.append(int(first[i + 1] - first[i]))
                    gone.append(int(hit[first[i] : first[i + 1]].sum()))
                    ranges.append(",".join(f"{a}:{b}" for a, b in pairs))
                yield pa.record_batch({"doc_id": part.column(0), "text": pa.array(out, pa.binary()).cast(pa.string()), "n_sentences": pa.array(many, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(ranges, pa.string())})

    return joined.mapInArrow(f, "doc_id long, text string, n_sentences long, n_removed long, removed string")


def brute_force(rows: list[tuple[int, str | None]], run: int = RUN, least_words: int = LEAST_WORDS) -> list[tuple]:
    """doc_id, text, n_sentences, n_removed by plain comparison, for tests."""
    import re

    import xxhash

    def cut_up(t: str) -> list[tuple[int, list[str]]]:
        out: list[tuple[int, list[str]]] = []
        end = True
        prev = 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t):
            if end or "\n" in t[prev : m.start()]:
                out.append((m.start(), []))
            out[-1][1].append("".join(c.lower() if c.isascii() else c for c in m[0]))
            end, prev = m[0][-1] in ".!?", m.end()
        return out

    key = lambda d, t: (d, xxhash.xxh64_intdigest((t or "").encode(), seed=42) + 2**63 & 2**64 - 1)  # noqa: E731  in the order of signed numbers
    docs = {key(d, t): cut_up(t or "") for d, t in rows if d is not None}
    first: dict[tuple, tuple] = {}
    found: dict[tuple, set[int]] = {d: set() for d in docs}
    for d in sorted(docs):
        flat = [w for _, ws in docs[d] for w in ws]
        starts = [0]
        for _, ws in docs[d]:
            starts.append(starts[-1] + len(ws))
        own, sure = set(), set()
        for i in range(len(docs[d])):
            enough = next((e for e in starts[i + 1 :] if e - starts[i] >= least_words), None)
            end = next((e for e in starts[i + run :] if e - starts[i] >= least_words), None)
            if enough is not None:
                own.add((starts[i], enough))
                sure.add((starts[i], enough))
            if end is not None or i == 0:
                own.add((starts[i], len(flat) if end is None else end))
        value = text.windows(text.Words(*text.utf8(pa.array([" ".join(flat)])), text.SPACE_WORDS).hashes(), 4).tolist()
        for s in range(len(flat) - SURE_WORDS + 1):
            if not any(s < a and b < s + SURE_WORDS for a, b in sure):
                at = min(range(s, s + SURE_WORDS - PIECE_WORDS + 1), key=value.__getitem__)
                own.add((at, at + PIECE_WORDS))
        for a, b in sorted(own):
            if first.setdefault(tuple(flat[a:b]), (d, a)) != (d, a):
                found[d] |= set(range(a, b))
    out = []
    for d, t in rows:
        t = t or ""
        gone, sentences = (set(), cut_up(t)) if d is None else (found[key(d, t)], docs[key(d, t)])
        at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] + [len(t)]
        kept = t[: at[0]] + "".join(t[at[k] : at[k + 1]] for k in range(len(at) - 1) if k not in gone)
        bounds = [0]
        for _, ws in sentences:
            bounds.append(bounds[-1] + len(ws))
        out.append((d, kept, len(sentences), sum(not gone.isdisjoint(range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False))))
    return out
