"""Blocks of token ids, coded by an adaptive context-mixing range coder.

A block is reset to the same start state, carries a CRC-32 of its ids, and can be decoded alone. Its ids are dealt over up to LANES
lanes (consecutive stretches), each with a range coder of its own; in a step every lane codes its next id, and then the
model, which all lanes share, is updated by what they coded. So numpy does the work of a step for all lanes at once, and the
decoder repeats the encoder's every step. All arithmetic is on integers, so that any machine decodes what another wrote.

An id is coded as up to two decisions:
1. is it the candidate: what followed the last two ids before (order 2), or, where nothing reliable is known of those, what followed
   the last id (order 1)? The probability mixes, in the logistic domain, what orders 2, 1 and 0 say of the candidate, with
   weights that are trained as the coder runs;
2. else the id itself, by the adaptive frequencies of order 0.

Layout (little-endian): magic "EIDS", version u16, lanes u16, number of ids u32, CRC-32 of the ids as u32 values u32, highest
id + 1 u32, bytes of a size u32 (2, or 4 if a lane has more than 65,535 words), number of listed ids u32, the listed ids as u32, then the number of 16-bit words of each lane,
then the lanes' words. Ids are listed (each id of the block once, ascending) where one is 2^17 or more; what is coded then are their places in the list. Words after a lane's last are read as 0, so a lane ends with the fewest words that name a number within its range.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from . import text

MAGIC = b"EIDS"
VERSION = 3
HEAD = 28
#: Blocks with higher ids list the ids that they hold.
MOST_ID = 1 << 17
LANES = 8192
#: A lane has at least so many ids, so that short blocks have few lanes.
LEAST_STEPS = 64

#: Binary decisions have 16-bit probabilities, order 0 has 2^20 slots, or eight for every id if those are more.
P_BITS, O_BITS = 16, 20
_ONE = 1 << P_BITS
_HASH_BITS = 18
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_LOW32 = np.uint64((1 << 32) - 1)
#: Order-0 frequencies are counted anew after these steps, and then every REBUILD steps.
_EARLY, REBUILD = (1, 2, 4, 8, 16), 32

#: stretch(p) = ln(p / (1 - p)) in 1/256, for 12-bit p; squash is its inverse, for -2047..2047, with 16-bit p.
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], dtype=np.int32)
_SQUASH = np.array([min(_ONE - 32, max(32, round(_ONE / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.uint64)


#: What sureness 0 to 15 gains when the guess was wrong (an id of sureness 0 is replaced), and when it was right.
_SURER = np.array([0, *[-1] * 15, *[1] * 15, 0], dtype=np.int32)

#: 16 grades of sureness (or frequency), each with and without agreement of two orders.
_CONTEXTS = 32


class _Counts:
    """Adaptive probabilities of a few dozen contexts, as counts of both outcomes."""

    def __init__(self, n: int):
        self.both = np.ones((n, 2), dtype=np.int64)

    def stretched(self) -> np.ndarray:
        """Of all contexts."""
        return _STRETCH[(self.both[:, 1] * 4096 // self.both.sum(axis=1)).clip(1, 4094)]

    def update(self, context: np.ndarray, hit: np.ndarray) -> None:
        self.both += np.bincount(context * 2 + hit, minlength=2 * len(self.both)).reshape(-1, 2)
        big = self.both.sum(axis=1) > 1 << 16
        self.both[big] = (self.both[big] + 1) >> 1


class _Mixer:
    """Logistic mixing of what orders 2, 1 and 0 say (_CONTEXTS contexts each); the order-2 context chooses the weights (1/65536).

    Products of weights and inputs are kept in tables until the next update, so a prediction is two look-ups."""

    def __init__(self):
        self.counts = [_Counts(_CONTEXTS) for _ in range(3)]
        self.weights = np.full((3, _CONTEXTS), 65536 // 2, dtype=np.int32)
        self._tables()

    def _tables(self) -> None:
        self.inputs = [c.stretched() for c in self.counts]
        of1, of0 = (np.outer(w, x) for w, x in zip(self.weights[1:], self.inputs[1:], strict=True))
        # orders 2 and 1 in one table, as the order-2 context is the row of both
        self.of21 = ((self.weights[0] * self.inputs[0])[:, None] + of1).ravel()
        self.of0 = of0.ravel()

    def p(self, x2: np.ndarray, x1: np.ndarray, x0: np.ndarray) -> np.ndarray:
        row = x2 * _CONTEXTS
        total = self.of21.take(row + x1)
        total += self.of0.take(row + x0)
        total >>= 16
        np.clip(total, -2047, 2047, out=total)
        total += 2047
        return _SQUASH.take(total)

    def update(self, x2: np.ndarray, x1: np.ndarray, x0: np.ndarray, p: np.ndarray, hit: np.ndarray) -> None:
        error = hit * np.int64(_ONE) - p.astype(np.int64)
        n = np.maximum(np.bincount(x2, minlength=_CONTEXTS), 1)
        for w, context, of, counts in zip(self.weights, (x2, x1, x0), self.inputs, self.counts, strict=True):
            # sums of whole numbers below 2^53 are exact in the floats of bincount
            g = np.bincount(x2, weights=(error * of[context]) >> 8, minlength=_CONTEXTS).astype(np.int64)
            w += (g // n).astype(np.int32)
            counts.update(context, hit)
        np.clip(self.weights, -(1 << 18), 1 << 18, out=self.weights)
        self._tables()


class _Model:
    """What both sides know. predict() and update() are called in the same order by encoder and decoder.

    A context's entry holds the id that followed it, and in the low four bits how sure that is."""

    def __init__(self, lanes: int, top: int):
        self.top, self.bits = top, max(O_BITS, (top - 1).bit_length() + 3)
        self.after1, self.after2 = np.zeros(top, dtype=np.int32), np.zeros(1 << _HASH_BITS, dtype=np.int32)
        self.counts = np.zeros(top, dtype=np.int64)
        self.seen: list[np.ndarray] = []
        self.mixer = _Mixer()
        self.before = np.zeros(lanes, dtype=np.int32)
        self.before2 = np.zeros(lanes, dtype=np.int32)
        self.step = 0
        self._frequencies()

    def _frequencies(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.top)
            self.seen = []
        room = (1 << self.bits) - self.top
        f = 1 + self.counts * room // max(1, int(self.counts.sum()))
        f[0] += (1 << self.bits) - int(f.sum())
        self.frequency = f.astype(np.uint64)
        self.below = (np.cumsum(f) - f).astype(np.uint64)
        # a logarithm of the frequency, 0..15, twice
        self.size = np.searchsorted(1 << (np.arange(1, 16) + (self.bits - O_BITS)), f, "right").astype(np.int32) * 2
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(self.top, dtype=np.int32), self.frequency.astype(np.int64))
        return self._slots

    def predict(self) -> np.ndarray:
        """Probability (16 bits) that the next id is self.guess."""
        i2 = self.before2.view(np.uint32) * np.uint32(0x9E3779B1)
        i2 += self.before.view(np.uint32) * np.uint32(0x85EBCA6B)
        i2 >>= np.uint32(32 - _HASH_BITS)
        self.i2 = i2
        self.e2, self.e1 = self.after2.take(i2), self.after1.take(self.before)
        self.c2, self.c1 = self.e2 & 15, self.e1 & 15
        self.a, self.b = self.e2 >> 4, self.e1 >> 4
        long, same = self.c2 > 0, self.a == self.b
        self.guess = np.where(long, self.a, self.b)
        self.x2 = (self.c2 << 1) + same
        self.x1 = (self.c1 << 1) + same
        self.x0 = self.size.take(self.guess)
        self.x0 += long
        self.p = self.mixer.p(self.x2, self.x1, self.x0)
        return self.p

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        if self.step < 16 or self.step % 16 == 0:
            self.mixer.update(self.x2, self.x1, self.x0, self.p, hit)
        fresh = ids << 4
        for after, at, guess, entry, sure in ((self.after2, self.i2, self.a, self.e2, self.c2), (self.after1, self.before, self.b, self.e1, self.c1)):
            # of lanes with one context, the last one writes
            new = entry + _SURER.take(sure + ((ids == guess) << 4))
            unsure = np.flatnonzero(sure == 0)
            if len(unsure):
                new[unsure] = np.where(ids[unsure] == guess[unsure], new[unsure], fresh[unsure])
            after[at] = new
        self.seen.append(ids)
        self.before2, self.before = self.before, ids
        self.step += 1
        if self.step in _EARLY or self.step % REBUILD == 0:
            self._frequencies()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes) if n else 0


def encode(ids: np.ndarray) -> bytes:
    """A block with these ids, any of 32 bits."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    lanes, steps = _shape(n)
    coded, listed = ids, np.zeros(0, np.uint32)
    if n and int(ids.max()) >= MOST_ID:
        listed, coded = np.unique(ids, return_inverse=True)
    top = int(coded.max()) + 1 if n else 1
    table = np.zeros(lanes * steps, dtype=np.int32)
    table[:n] = coded
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    low, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    wide = 2 * steps + 40  # words of a lane, before more are needed
    out, filled = np.zeros(lanes * wide, dtype=np.uint16), np.zeros(lanes, dtype=np.int64)
    begin = np.arange(lanes) * wide

    def put(where: np.ndarray | None, below: np.ndarray, width: np.ndarray, bits: int) -> None:
        """where: the lanes that code something, None for all."""
        r = (size if where is None else size.take(where)) >> np.uint64(bits)
        lo = below * r
        lo += low if where is None else low.take(where)
        r *= width
        go = np.flatnonzero(((lo ^ (lo + r)) < _TOP) | (r < _BOTTOM))
        while len(go):
            x, y = lo[go], r[go]
            tight = (x ^ (x + y)) >= _TOP  # no carry can be left open: the range is cut to what has settled
            if tight.any():
                y = np.where(tight, (~x + np.uint64(1)) & _LOW32, y)
            lane = go if where is None else where[go]
            at = filled.take(lane)
            out[begin.take(lane) + at] = x >> np.uint64(48)
            filled[lane] = at + 1
            x <<= np.uint64(16)
            y <<= np.uint64(16)
            lo[go], r[go] = x, y
            go = go[((x ^ (x + y)) < _TOP) | (y < _BOTTOM)]
        if where is None:
            low[:], size[:] = lo, r
        else:
            low[where], size[where] = lo, r

    model, every = _Model(lanes, top), np.arange(lanes)
    one = np.uint64(_ONE)
    for t in range(steps):
        now = table[t]
        p = model.predict()
        hit = now == model.guess
        put(None, np.where(hit, np.uint64(0), p), np.where(hit, p, one - p), P_BITS)
        deep = np.flatnonzero(~hit)
        if len(deep):
            own = now[deep]
            put(deep, model.below[own], model.frequency[own], model.bits)
        model.update(now, hit)
        if t % 8 == 7 and filled.max(initial=0) + 40 > wide:
            out = np.concatenate([out.reshape(lanes, wide), np.zeros((lanes, steps + 40), dtype=np.uint16)], axis=1).ravel()
            wide += steps + 40
            begin = np.arange(lanes) * wide
    # the range is at least 2^32, so two words name a number within it; often one does
    for bits in (48, 32):
        mask = np.uint64((1 << bits) - 1)
        last = (low + mask) & ~mask
        fits = (last >= low) & (last - low < size)
        if bits == 48:
            one_word, last_one = fits, last
    last = np.where(one_word, last_one, last)
    out[begin + filled] = (last >> np.uint64(48)).astype(np.uint16)
    out[begin + filled + 1] = ((last >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    filled += np.where(one_word, 1, 2)
    width = 2 if filled.max(initial=0) < 1 << 16 else 4
    head = MAGIC + struct.pack("<HHIIIII", VERSION, lanes, n, zlib.crc32(ids.astype("<u4").tobytes()), top, width, len(listed)) + listed.astype("<u4").tobytes()
    return head + filled.astype(f"<u{width}").tobytes() + out[text.ragged(begin, filled)].astype("<u2").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it isn't whole."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    if len(block) < HEAD:
        raise ValueError("a block was cut off")
    version, lanes, n, crc, top, width, many = struct.unpack_from("<HHIIIII", block, 4)
    if version != VERSION or (lanes, n) != (_shape(n)[0], n):
        raise ValueError("a block of another version")
    steps = _shape(n)[1]
    start = HEAD + 4 * many
    if width not in (2, 4) or len(block) < start + width * lanes or len(block) % 2 or many not in (0, top):
        raise ValueError("a block was cut off")
    listed = np.frombuffer(block, "<u4", many, HEAD)
    sizes = np.frombuffer(block, f"<u{width}", lanes, start).astype(np.int64)
    words = np.frombuffer(block, "<u2", offset=start + width * lanes)
    if len(words) != sizes.sum():
        raise ValueError("a block was cut off")
    words = np.append(words, np.zeros(4, np.uint16)).astype(np.uint64)
    stop = np.cumsum(sizes)
    at = stop - sizes
    low, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    code = np.zeros(lanes, dtype=np.uint64)

    def word(lane: np.ndarray) -> np.ndarray:
        got = np.where(at[lane] < stop[lane], words[np.minimum(at[lane], len(words) - 1)], np.uint64(0))
        at[lane] += 1
        return got

    every = np.arange(lanes)
    for _ in range(4):
        code = (code << np.uint64(16)) | word(every)

    def take(where: np.ndarray | None, r: np.ndarray, below: np.ndarray, width: np.ndarray) -> None:
        lo = below * r
        lo += low if where is None else low.take(where)
        r *= width
        go = np.flatnonzero(((lo ^ (lo + r)) < _TOP) | (r < _BOTTOM))
        c = code if where is None else code.take(where)
        while len(go):
            x, y = lo[go], r[go]
            tight = (x ^ (x + y)) >= _TOP
            if tight.any():
                y = np.where(tight, (~x + np.uint64(1)) & _LOW32, y)
            c[go] = (c[go] << np.uint64(16)) | word(go if where is None else where[go])
            x <<= np.uint64(16)
            y <<= np.uint64(16)
            lo[go], r[go] = x, y
            go = go[((x ^ (x + y)) < _TOP) | (y < _BOTTOM)]
        if where is None:
            low[:], size[:] = lo, r  # code is changed in place
        else:
            low[where], size[where], code[where] = lo, r, c

    table = np.zeros((steps, lanes), dtype=np.int32)
    model, one = _Model(lanes, top), np.uint64(_ONE)
    for t in range(steps):
        p = model.predict()
        r = size >> np.uint64(P_BITS)
        hit = code - low < r * p
        take(None, r, np.where(hit, np.uint64(0), p), np.where(hit, p, one - p))
        now = model.guess
        deep = np.flatnonzero(~hit)
        if len(deep):
            r = size[deep] >> np.uint64(model.bits)
            slot = np.minimum((code[deep] - low[deep]) // r, np.uint64((1 << model.bits) - 1))
            own = model.slots()[slot]
            take(deep, r, model.below[own], model.frequency[own])
            now[deep] = own
        table[t] = now
        model.update(table[t], hit)
    ids = np.ascontiguousarray(table.T).ravel()[:n].astype(np.uint32)
    if many:
        ids = listed[ids]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids don't have its checksum")
    return ids
