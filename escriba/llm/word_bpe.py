"""Encoding by a tokenizer file of the tokenizers library, with every distinct pre-token encoded once in a worker.

Pre-tokens are found by vectorised splitting (pretokens), hashed and looked up; only unknown ones go to the library's
merges. Texts with code points from U+0300 on, or with "<|", take the same way code point by code point: special tokens are
cut out, the rest is normalised (NFC, lower case) and split. What normalisation and the pattern make of a code point is asked of the
library itself, once for each code point in a worker; a text that holds one of which Python's Unicode tables think otherwise is normalised by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import text
from .merging import Ranks, merge_words
from .pretokens import BYTE_LEVEL, LETTER, NUMBER, OTHER, SPACE, Memory, Points, lowered, merged, word_split

#: Distinct pre-tokens that a worker remembers; beyond it begins anew.
MEMORY = 400_000
SUFFIX = "</w>"


def load(path: str) -> str:
    """The tokenizer file as a string, to be sent to the executors (a vocabulary is a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class CodePoints:
    """What the library makes of single code points: its class in the pattern, and whether Python normalises it alike."""

    UNKNOWN = 255

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.classes = np.full(0x110000, self.UNKNOWN, dtype=np.uint8)
        self.alike = np.full(0x110000, self.UNKNOWN, dtype=np.uint8)

    def _class(self, c: str) -> int:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if not split(c):
            return SPACE
        if len(split(f"a{c}a")) == 1:
            return LETTER
        return OTHER if len(split(f"!{c}!")) == 1 else NUMBER

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == self.UNKNOWN).any():
            for p in np.unique(points[out == self.UNKNOWN]).tolist():
                self.classes[p] = self._class(chr(p))
            out = self.classes[points]
        return out

    def _alike(self, c: str) -> bool:
        shown = self.tokenizer.normalizer.normalize_str(c)
        return unicodedata.category(c) != "Cn" and (shown == _normalise(c) or not shown.strip() and not c.strip())

    def normalise(self, value: str) -> str:
        """As the library does, but for white space (which no pre-token holds)."""
        points = set(map(ord, set(value)))
        for p in points:
            if self.alike[p] == self.UNKNOWN:
                self.alike[p] = self._alike(chr(p))
        return _normalise(value) if all(self.alike[p] for p in points) else self.tokenizer.normalizer.normalize_str(value)


def _normalise(value: str) -> str:
    # lower case of each character for itself: a final sigma is one like any other
    return unicodedata.normalize("NFC", value).replace("\u03a3", "\u03c3").lower()


class Encoder:
    """ids of texts. whole: pre-tokens proven to be one token, with its id; they aren't merged."""

    def __init__(self, spec: str, whole: dict[str, int] | None = None):
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.whole = whole or {}
        parsed = json.loads(spec)
        #: special tokens' strings are taken out of a text before anything else, the leftmost first and the longest of several
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        vocabulary = parsed["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        number = lambda tokens: np.array([vocabulary[t] for t in tokens], dtype=np.int64)
        self.ranks = Ranks(number(a for a, _ in pairs), number(b for _, b in pairs), number(a + b for a, b in pairs))
        self.byte = number(BYTE_LEVEL[b] for b in range(256))
        self.last_byte = number(BYTE_LEVEL[b] + SUFFIX for b in range(256))
        self.memory = Memory(MEMORY)
        self.points = CodePoints(self.tokenizer)
        self._begin()

    def _begin(self) -> None:
        """A memory that holds the proven whole tokens and no more."""
        self.memory.clear()
        if self.whole:
            words = [w.encode() for w in self.whole]
            end = np.cumsum([len(w) for w in words])
            ids = np.fromiter(self.whole.values(), np.int64, len(words))
            self.memory.numbers(np.frombuffer(b"".join(words), np.uint8), np.append(0, end[:-1]), end, lambda raw, a, b: (ids[np.searchsorted(end, a, "right")], np.ones(len(a), np.int64), np.ones(len(a), bool)))

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, count, long = merge_words(raw, start, end, self.byte, self.last_byte, self.ranks)
        if len(long):
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in long.tolist():
                shown = raw[start[i] : end[i]].tobytes().decode("latin-1").translate(BYTE_LEVEL)
                parts[i] = np.array([t.id for t in self.model.tokenize(shown)], dtype=np.int32)
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count, np.zeros(len(start), dtype=bool)

    def _hard(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens and special tokens of these texts in turn, and how many each text has."""
        segments, special, doc = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.cut.finditer(t):
                segments.append(self.points.normalise(t[at : m.start()]))
                special.append(self.special[m[0]])
                at = m.end()
                doc.append(i)
            segments.append(self.points.normalise(t[at:]))
            special.append(-1)
            doc.append(i)
        points = Points(segments)
        split = points.split(self.points.classes_of(points.points), True)
        number = self.memory.numbers(points.raw, split.start, split.end, self._encode)
        own = np.diff(split.first)
        after = np.array(special) >= 0
        count = own + after
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        out[text.ragged(begin, own)] = number
        if after.any():
            ids = np.array(special)[after]
            kinds, which = np.unique(ids, return_inverse=True)
            out[(begin + own)[after]] = self.memory.add(np.zeros(len(kinds), np.uint64), kinds, np.ones(len(kinds), np.int64), np.ones(len(kinds), bool))[which]
        return out, np.bincount(np.array(doc), weights=count, minlength=len(texts)).astype(np.int64)

    def look_up(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number (in the memory) of every pre-token, and their offsets by document."""
        if self.memory.full():
            self._begin()
        raw, offsets = text.utf8(column)
        split = word_split(raw, offsets)
        number = self.memory.numbers(lowered(raw), split.start, split.end, self._encode)
        hard = np.flatnonzero(split.hard)
        if not len(hard):
            return number, split.first
        others, count = self._hard([column[i].as_py() for i in hard.tolist()])
        return merged(number, split.first, others, hard, count)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: tokens, and those of them that were counted without merging."""
        number, first = self.look_up(column)
        n = np.diff(np.append(0, np.cumsum(self.memory.count[number]))[first])
        return n, np.diff(np.append(0, np.cumsum(self.memory.direct[number]))[first])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        number, first = self.look_up(column)
        ids, count = self.memory.expand(number)
        return ids, np.diff(np.append(0, np.cumsum(count))[first])


def prove_whole(spec: str) -> dict[str, int]:
    """Offline: the pre-tokens that encode alone as one token, each proven by the library's own merges.

    Candidates are the vocabulary's entries with the word-end suffix whose bytes are valid UTF-8 in lower case."""
    tokenizer = Tokenizer.from_str(spec)
    model, back = tokenizer.model, {c: b for b, c in BYTE_LEVEL.items()}
    out = {}
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(SUFFIX) or entry == SUFFIX:
            continue
        shown = entry[: -len(SUFFIX)]
        try:
            word = bytes(back[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        found = model.tokenize(shown)
        if len(found) == 1 and found[0].id == i and word == word.lower():
            out[word] = i
    return out


_WORKERS: dict[int, Encoder] = {}


def worker_encoder(spec: str, whole: dict[str, int] | None = None) -> Encoder:
    """One encoder for each tokenizer in a worker process, kept over tasks."""
    key = hash((spec, len(whole or ())))
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Encoder(spec, whole)
    return _WORKERS[key]
