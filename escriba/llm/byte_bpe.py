"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one last token that a valid encoding can end with: a token t that ends there, such that t and
the last token of what stands before it are a valid pair (merging their bytes alone gives just those two). These last tokens are
stored for each byte, so a piece is encoded in one pass from left to right, bytes can be appended exactly, and after an edit
only the bytes from the edit on are computed again, until the stored tokens repeat. Encodings are read off backwards.

As the tiktoken library does, a piece that is itself a vocabulary entry is that one token, whatever its merges would give.

Defined results: null and empty texts have no ids; repeated rows, and rows without a doc_id, are answered each for itself. An empty table has no rows; other columns are neither
read nor returned. A very long text is a slice by itself; a piece of any length (without a break in the text) is encoded in one pass, its prefix tokens held in memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import frames, text
from .pretokens import CLASSES, LETTER, LIMIT, NUMBER, OTHER, SPACE, Memory, Points, merged, space_split

MEMORY = 300_000
#: Bytes from behind that tell how long a token can be.
TAIL = 5
# Fixed value: the split pattern that pretokens.space_split follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PointClasses:
    """The pattern's class of code points, as the tiktoken library's own Unicode tables have it: each is asked for once, by how that library cuts short
    texts with it. The small vocabulary that shows the cuts has all bytes, "'s", and "a" with each byte that begins a character."""

    UNKNOWN = 255

    def __init__(self, pattern: str):
        tokens = [*(bytes([b]) for b in range(256)), b"'s", *(b"a" + bytes([b]) for b in range(0xC2, 0xF5))]
        self.cuts = tiktoken.Encoding("cuts", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}).encode_ordinary
        self.table = np.full(0x110000, self.UNKNOWN, dtype=np.uint8)
        self.table[:LIMIT] = CLASSES[:LIMIT]

    def _class(self, c: str) -> int:
        if regex.match(r"\s", c):  # a set that no new version of Unicode has changed for long
            return SPACE
        if 256 not in self.cuts(c + "'s"):
            return OTHER
        return LETTER if self.cuts("a" + c)[0] > 256 else NUMBER

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == self.UNKNOWN).any():
            for p in np.unique(points[out == self.UNKNOWN]).tolist():
                self.table[p] = self._class(chr(p))
            out = self.table[points]
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token, and its rank, on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """Plain merging, lowest rank first: what defines the encoding. For short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, rank = -1, len(ranks) + 1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < rank:
                best, rank = i, r
        if best < 0:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = {i: t for t, i in ranks.items()}
        #: tokens that merging their bytes really gives; others can only be whole pieces
        self.stable = {t: i for t, i in ranks.items() if len(t) == 1 or merge(ranks, t) == [t]}
        self.longest = max(map(len, self.stable), default=1)
        #: of tokens of at least TAIL bytes, by those they end with, the length of the longest
        self.reach: dict[bytes, int] = {}
        for t in self.stable:
            if len(t) >= TAIL:
                self.reach[t[-TAIL:]] = max(len(t), self.reach.get(t[-TAIL:], 0))
        self.pairs: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a in a valid encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.by_id[a], self.by_id[b]
            if len(self.pairs) > 2 * MEMORY:
                self.pairs.clear()
            known = self.pairs[a, b] = merge(self.ranks, x + y) == [x, y]
        return known

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix; known: those of the first prefixes."""
        last = list(known or ())
        stable, fits, pairs, reach = self.stable.get, self.fits, self.pairs.get, self.reach.get
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - reach(piece[max(0, end - TAIL) : end], TAIL - 1)), end):
                t = stable(piece[start:end])
                if t is not None:
                    good = pairs((last[start - 1], t)) if start else True
                    if good or good is None and fits(last[start - 1], t):
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.by_id[last[at - 1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.last_tokens(piece))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Of many pieces; in the order of their bytes, each goes on from the prefix that it shares with the one before."""
        out: list[list[int]] = [[]] * len(pieces)
        before, last = b"", []
        for i in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[i]
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
                continue
            same = next((k for k, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))
            before, last = piece, self.last_tokens(piece, last[:same])
            out[i] = self.walk(last)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


class Prefixes:
    """A piece that grows and changes, with the last token of each of its prefixes."""

    def __init__(self, bpe: Bpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, bpe.last_tokens(piece)
        self.computed = len(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.last = self.bpe.last_tokens(self.piece, self.last)
        self.computed += len(more)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start to end. What follows is computed until as many last tokens as the longest token has bytes are the old ones; from there on all are."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last, same = old[:start], 0
        while len(last) < len(self.piece) and same < self.bpe.longest:
            at = len(last)
            last = self.bpe.last_tokens(self.piece[: at + 1], last)
            self.computed += 1
            same = same + 1 if at >= start + len(new) and last[at] == old[at - shift] else 0
        self.last = last + old[len(last) - shift :] if len(last) < len(self.piece) else last

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.piece)
        return [whole] if whole is not None else self.bpe.walk(self.last)


class Encoder:
    """ids of whole texts, each match of the pattern separately; every distinct piece is encoded once in a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = Bpe(ranks)
        self.pattern = regex.compile(pattern)
        #: the pattern that pretokens splits by; pieces of any other are found by the pattern itself
        self.ours = pattern == PATTERN
        top = max(ranks.values(), default=-1) + 1
        size = np.zeros(top, dtype=np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        self.size, self.begin = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(t for _, t in sorted((i, t) for t, i in ranks.items())), np.uint8)
        self.memory = Memory(MEMORY)
        self.classes = PointClasses(pattern)

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blob = raw.tobytes()
        ids = self.bpe.encode_pieces([blob[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64), np.zeros(len(ids), dtype=bool)

    def _hard(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of these texts in turn, and how many each has."""
        if not self.ours:
            found = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
            raw = np.frombuffer(b"".join(p for f in found for p in f), np.uint8)
            ends = np.cumsum([len(p) for f in found for p in f])
            return self.memory.numbers(raw, np.append(0, ends[:-1])[: len(ends)].astype(np.int64), ends.astype(np.int64), self._encode), np.array([len(f) for f in found], dtype=np.int64)
        points = Points(texts)
        split = points.split(self.classes.of(points.points), False)
        return self.memory.numbers(points.raw, split.start, split.end, self._encode), np.diff(split.first)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        if self.memory.full():
            self.memory.clear()
        raw, offsets = text.utf8(column)
        split = space_split(raw, offsets)
        if self.ours:
            number, first = self.memory.numbers(raw, split.start, split.end, self._encode), split.first
            hard = np.flatnonzero(split.hard)
        else:
            number, first, hard = np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64), np.arange(len(column))
        if len(hard):
            others, count = self._hard([column[i].as_py() for i in hard.tolist()])
            number, first = merged(number, first, others, hard, count)
        ids, count = self.memory.expand(number)
        return ids, np.diff(np.append(0, np.cumsum(count))[first])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in turn, and the offsets of each."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        return self.blob[text.ragged(self.begin[ids], size)], ends[np.append(0, np.cumsum(n))]


_WORKERS: dict[int, Encoder] = {}


def worker_encoder(key: int, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Encoder(ranks, pattern)
    return _WORKERS[key]


def _shared(docs: DataFrame, path: str, pattern: str):
    ranks = load_ranks(path)
    key = hash((pattern, *sorted(ranks.items())))
    return docs.sparkSession.sparkContext.broadcast((key, ranks, pattern))  # as large as the vocabulary


def report(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the decimal ids joined by commas, and of the bytes that decoding the ids gives; with_ids: the ids too.

    Null and empty texts have no ids and the hashes of the empty string; repeated rows are answered each for itself."""
    shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(*shared.value)
        decimal = [str(i) for i in range(len(encoder.size))]
        for batch in batches:
            for part in text.slices(batch, most=1 << 20):
                ids, n = encoder.encode(part.column(1))
                decoded, offsets = encoder.decode(ids, n)
                shown = list(map(decimal.__getitem__, ids.tolist()))
                first, raw = np.append(0, np.cumsum(n)).tolist(), decoded.tobytes()
                off = offsets.tolist()
                more = {"ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))} if with_ids else {}
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_tokens": n.astype(np.int64),
                        "ids_sha256": [hashlib.sha256(",".join(shown[a:b]).encode()).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)],
                        "decoded_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)],
                    }
                    | more
                )

    return frames.doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
