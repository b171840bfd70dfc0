"""Text as bytes: slices of Arrow batches, word boundaries and word hashes, all vectorised over many documents at once.

A slice is a few megabytes of whole documents, so memory follows the slice (or one very long document), not the
partition. Words are maximal runs of bytes of a class; every class used here is a union of ASCII bytes with either all
or none of the bytes from 0x80 up, so runs of bytes are runs of whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Longer byte ranges are hashed by BLAKE2b, one by one.
LONG = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(separators: str) -> np.ndarray:
    """A 256-entry table, true for bytes of words. separators: "space" for U+0020 and U+0009-U+000D, "symbol" for every ASCII character but letters and digits."""
    table = np.ones(256, dtype=bool)
    if separators == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


SPACE_WORDS = byte_class("space")
ALNUM_WORDS = byte_class("symbol")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most so many bytes of text, one row at least. Null texts become empty."""
    at = batch.schema.get_field_index(text)
    column = batch.column(at)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    batch = batch.set_column(at, pa.field(text, pa.string()), column)
    sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64))) if len(column) else np.zeros(0, np.int64)
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(start, end - start)
        start, done = end, int(sizes[end - 1])


def rows_with_text(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive rows of a batch, all columns as they are, and beside them their texts as slices() gives them."""
    at = 0
    for part in slices(pa.record_batch([batch.column(batch.schema.get_field_index(name))], names=["text"]), most=most):
        yield batch.slice(at, part.num_rows), part.column(0)
        at += part.num_rows


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its len + 1 offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of many documents. start, end: byte offsets; doc: index of the document; first: len(documents) + 1 offsets into the words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        self.bytes = LOWER[raw] if lower else raw
        self.offsets = offsets
        n = len(raw)
        self.inside = inside = table[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[offsets] = True
        cut = np.flatnonzero(edge)
        cut = cut[cut < n]
        keep = inside[cut]
        self.start = cut[keep]
        self.end = np.append(cut[1:], n)[keep] if len(cut) else cut
        self.first = np.searchsorted(self.start, offsets, "left")
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._eights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, end: np.ndarray) -> np.ndarray:
        if self._eights is None:
            self._eights = eights(self.bytes)
        return fingerprints(self._eights, self.start, end)[0]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self._hash(self.end)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """A 64-bit hash of each word's first n bytes (the whole word if it is shorter)."""
        return self._hash(np.minimum(self.end, self.start + n))

    def forget(self) -> None:
        """Drop what only hashing needs, before the words are sent anywhere."""
        self._eights = None

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one little-endian number; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def fingerprints(view: np.ndarray, start: np.ndarray, end: np.ndarray, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each byte range, and (if asked for) a second number that tells ranges of equal hash apart. view: eights() of the bytes.

    Ranges of up to seven bytes have hashes of their own: the bytes and the length, mixed one to one; there the second number is just those. Of longer
    ranges, both are hashes of all eights in order, with multipliers of their own."""
    n = end - start
    first = view.take(start) & _MASK[np.minimum(n, 8)]
    exact = first | (np.minimum(n, 8).astype(np.uint64) << np.uint64(56))
    at = np.flatnonzero(n > 7)
    h = mix(exact)
    if not len(at):
        return h, exact
    size = n[at]
    both = []
    for seed in (0, 1) if check else (0,):
        step = _STEP + np.uint64(0x51ED270B2 * seed)
        value = mix((first[at] ^ np.uint64(seed * 0x6A09E667F3BCC909)) + size.astype(np.uint64) * step)
        live, j = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(live):
            left = size[live] - j
            value[live] = mix(value[live] * step + (view.take(start[at[live]] + j) & _MASK[np.minimum(left, 8)]))
            j += 8
            live = live[size[live] > j]
        for i in np.flatnonzero(size > LONG).tolist():
            a, b = int(start[at[i]]), int(end[at[i]])
            value[i] = int.from_bytes(hashlib.blake2b(view.base[a:b], digest_size=8, salt=bytes([seed])).digest(), "little")
        both.append(value)
    h[at] = both[0]
    if check:
        exact[at] = both[1]
    return h, exact


def same_bytes(x: np.ndarray, x_start: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_start: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Whether each range of x holds the same bytes as the range of y of the same number."""
    size = x_end - x_start
    same = size == y_end - y_start
    at = np.flatnonzero(same & (size > 0))
    if len(at):
        differs = x[ragged(x_start[at], size[at])] != y[ragged(y_start[at], size[at])]
        ends = np.cumsum(size[at])
        same[at] = ~np.logical_or.reduceat(differs, ends - size[at])
    return same


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive values; len - k + 1 of them (none if there are fewer than k)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j : j + n])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (counts[i] of them), for all i in turn."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - counts), counts)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
