"""Pre-tokens of many documents at once, as byte ranges, for the two split patterns of the vocabularies used here.

Both patterns split by runs of letters, numbers, white space and anything else, and take the English contractions apart.
For texts of code points below U+0300 (where normal forms change nothing and one or two bytes make a character) the
classes are looked up byte by byte; other texts are marked, and the caller has them split by the same rules code point by code point
(word_points, space_points). Either way the pre-tokens go through one memory of encoded ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import text

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
LIMIT = 0x300


def _class(c: int) -> int:
    if c in (*range(9, 14), 0x20, 0x85, 0xA0):  # White_Space below U+0300
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


CLASSES = np.array([_class(c) for c in range(0x1000)], dtype=np.uint8)


#: Lower case of the code points below LIMIT, where that is one code point of two bytes or fewer; else 0.
_SMALL = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x800 else 0 for c in range(LIMIT)], dtype=np.int32)


def lowered(raw: np.ndarray) -> np.ndarray:
    """The same bytes in lower case, as far as code points below LIMIT go."""
    out = text.LOWER[raw]
    lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xCC))
    lead = lead[lead + 1 < len(raw)]
    small = _SMALL[((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)]
    lead, small = lead[small > 0], small[small > 0]
    out[lead] = 0xC0 | (small >> 6)
    out[lead + 1] = 0x80 | (small & 0x3F)
    return out


@dataclass
class PreTokens:
    start: np.ndarray
    end: np.ndarray
    #: len(documents) + 1 offsets into the pre-tokens
    first: np.ndarray
    #: of each document: whether it must be split by the pattern itself (it has no pre-tokens here)
    hard: np.ndarray


def _documents_with(where: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype=bool)
    if len(where):
        out[np.searchsorted(offsets, where, "right") - 1] = True
    return out


def _layout(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte's character, whether a byte begins a character, whether one begins a run of a class, hard documents."""
    n = len(raw)
    classes = CLASSES[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    lead = lead[lead + 1 < n]
    follow = raw[lead + 1]
    classes[lead] = CLASSES[((raw[lead].astype(np.int32) & 0x1F) << 6) | (follow & 0x3F)]
    classes[lead + 1] = classes[lead]
    begins = (raw & 0xC0) != 0x80
    run = np.zeros(n + 1, dtype=bool)
    run[1:n] = classes[1:] != classes[:-1]
    run[offsets] = True
    hard = _documents_with(np.flatnonzero(raw >= 0xCC), offsets)
    return classes, begins, run[:n] if n else run[:0], hard


def _contractions(raw: np.ndarray, classes: np.ndarray, starts: np.ndarray, same_doc: np.ndarray, alone: np.ndarray, fold: bool) -> None:
    """Move the start of the letters after an apostrophe that is a pre-token of its own: it takes s, t, m, d, re, ve or ll along."""
    n = len(raw)
    at = alone[(alone + 1 < n)]
    at = at[same_doc[at + 1]]
    if not len(at):
        return
    low = (lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)) if fold else (lambda b: b)
    one = low(raw[at + 1])
    two = np.where((at + 2 < n), low(raw[np.minimum(at + 2, n - 1)]), 0)
    two = np.where((at + 2 < n) & same_doc[np.minimum(at + 2, n - 1)], two, 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for which, width in ((short, 1), (long & ~short, 2)):
        p = at[which]
        starts[p + 1] = False
        rest = p + 1 + width
        ok = rest < n
        ok[ok] = same_doc[rest[ok]]
        rest = rest[ok]
        starts[rest[classes[rest] == LETTER]] = True


def _finish(starts: np.ndarray, keep: np.ndarray, offsets: np.ndarray, hard: np.ndarray, n: int) -> PreTokens:
    cut = np.flatnonzero(starts)
    end = np.append(cut[1:], n) if len(cut) else cut
    ok = keep[cut] & ~hard[np.searchsorted(offsets, cut, "right") - 1] if len(cut) else np.zeros(0, bool)
    start, end = cut[ok], end[ok]
    first = np.searchsorted(start, offsets, "left")
    first[-1] = len(start)
    return PreTokens(start, end, first, hard)


def _same_doc(n: int, offsets: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to the document of the byte before it."""
    out = np.ones(n + 1, dtype=bool)
    out[offsets] = False
    return out[:n]


def _lone_apostrophes(raw: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Apostrophes that are a whole run of other characters."""
    n = len(raw)
    at = np.flatnonzero((raw == 0x27) & run)
    return at[(at + 1 < n)][run[at[at + 1 < n] + 1]] if len(at) else at


def _word_starts(units: np.ndarray, classes: np.ndarray, begins: np.ndarray, run: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts = run | ((classes == NUMBER) & begins)
    _contractions(units, classes, starts, _same_doc(len(units), offsets), _lone_apostrophes(units, run), True)
    return starts


def _space_starts(units: np.ndarray, classes: np.ndarray, begins: np.ndarray, run: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts = run.copy()
    same = _same_doc(len(units), offsets)
    # runs of other classes that follow white space in the same document
    after = np.flatnonzero(run & (classes != SPACE) & same)
    after = after[classes[after - 1] == SPACE] if len(after) else after
    last = after - 1
    last = np.where(begins[last], last, last - 1) if len(last) else last  # the last white space character
    starts[last] = True
    starts[after[units[last] == 0x20]] = False
    alone = _lone_apostrophes(units, run)
    _contractions(units, classes, starts, same, alone[starts[alone]] if len(alone) else alone, False)
    return starts


def word_split(raw: np.ndarray, offsets: np.ndarray) -> PreTokens:
    """'s|'t|'re|'ve|'m|'ll|'d|letters+|number|others+ on lower-cased text, white space dropped. Texts with a character whose lower case needs more bytes, or with "<|" (it may begin a special token), are hard."""
    n = len(raw)
    classes, begins, run, hard = _layout(raw, offsets)
    if n > 1:
        lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] < 0xCC))
        wide = lead[_SMALL[((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)] == 0]
        at = np.flatnonzero(raw[:-1] == 0x3C)
        hard |= _documents_with(np.sort(np.concatenate([wide, at[raw[at + 1] == 0x7C]])), offsets)
    return _finish(_word_starts(raw, classes, begins, run, offsets), classes != SPACE, offsets, hard, n)


def space_split(raw: np.ndarray, offsets: np.ndarray) -> PreTokens:
    """'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?others+|\\s+(?!\\S)|\\s+"""
    n = len(raw)
    classes, begins, run, hard = _layout(raw, offsets)
    return _finish(_space_starts(raw, classes, begins, run, offsets), np.ones(n, dtype=bool), offsets, hard, n)


class Points:
    """Texts as code points, and where each code point stands in their UTF-8 bytes."""

    def __init__(self, texts: list[str]):
        whole = "".join(texts)
        self.points = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64)
        self.offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        self.raw = np.frombuffer(whole.encode(), np.uint8)
        width = 1 + (self.points >= 0x80) + (self.points >= 0x800) + (self.points >= 0x10000)
        self.place = np.append(0, np.cumsum(width))

    def split(self, classes: np.ndarray, drop_space: bool) -> PreTokens:
        """By code points' classes: word_split's pattern if white space is dropped, else space_split's. The ranges are of bytes of raw."""
        n = len(self.points)
        run = np.zeros(n + 1, dtype=bool)
        run[1:n] = classes[1:] != classes[:-1]
        run[self.offsets] = True
        rule = _word_starts if drop_space else _space_starts
        starts = rule(self.points, classes, np.ones(n, dtype=bool), run[:n], self.offsets)
        found = _finish(starts, (classes != SPACE) | (not drop_space), self.offsets, np.zeros(len(self.offsets) - 1, dtype=bool), n)
        return PreTokens(self.place[found.start], self.place[found.end], found.first, found.hard)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, an index of each, and the number of every element's value."""
    coded = pa.array(h).dictionary_encode()
    inverse = coded.indices.to_numpy().astype(np.int64)
    at = np.empty(len(coded.dictionary), dtype=np.int64)
    at[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    return coded.dictionary.to_numpy(), at, inverse


#: What Memory asks for new byte ranges (raw, start, end): ids in turn, how many each range has, and whether they were found without merging.
Encode = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Memory:
    """Pre-tokens encoded so far, each a number with its ids. A pre-token is known by a hash and a second number (see text.fingerprints); of one
    hash with another second number nothing is believed: such pre-tokens are encoded each time."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.check = np.zeros(0, dtype=np.uint64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.direct = np.zeros(0, dtype=bool)

    def add(self, check: np.ndarray, ids: np.ndarray, count: np.ndarray, direct: np.ndarray) -> np.ndarray:
        """New numbers for these ids (in turn, so many each)."""
        base = len(self.first)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self.check = np.concatenate([self.check, check])
        self.direct = np.concatenate([self.direct, direct])
        return np.arange(base, len(self.first))

    def numbers(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Encode) -> np.ndarray:
        """The number of every byte range."""
        if not len(start):
            return np.zeros(0, dtype=np.int64)
        h, check = text.fingerprints(text.eights(raw), start, end, True)
        values, at, inverse = distinct(h)
        own = values.tolist()
        found = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(found < 0)
        if len(new):
            where = at[new]
            found[new] = self.add(check[where], *encode(raw, start[where], end[where]))
            self.known.update(zip(values[new].tolist(), found[new].tolist(), strict=True))
        out = found[inverse]
        wrong = np.flatnonzero(self.check[out] != check)
        if len(wrong):
            out[wrong] = self.add(check[wrong], *encode(raw, start[wrong], end[wrong]))
        return out

    def full(self) -> bool:
        return len(self.first) > self.most

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers in turn, and how many each has."""
        count = self.count[numbers]
        return self.ids[text.ragged(self.first[numbers], count)], count


def merged(easy: np.ndarray, first: np.ndarray, others: np.ndarray, hard: np.ndarray, other_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all documents in turn, and their len(documents) + 1 offsets. easy, first: of documents that aren't hard (hard ones have none there); others, other_count: of the hard documents, in turn."""
    count = np.diff(first)
    count[hard] = other_count
    ends = np.append(0, np.cumsum(count))
    out = np.empty(int(ends[-1]), dtype=np.int64)
    simple = np.ones(len(count), dtype=bool)
    simple[hard] = False
    out[text.ragged(ends[:-1][simple], count[simple])] = easy
    out[text.ragged(ends[hard], other_count)] = others
    return out, ends


def byte_level() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LEVEL = byte_level()
