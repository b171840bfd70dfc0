"""MinHash near-duplicates with tensored banding.

Instead of L tables of K minhashes each (L x K hash computations), M sub-hashes of T minhashes are computed, and every
pair of them is the key of a table: M(M-1)/2 tables from M x T minhashes. A pair of similarity s shares a table if at
least two sub-hashes agree; with M = 14 and T = 2 a pair at s = 0.8 is missed with probability 1.6e-5.

Candidates without all pairs of a bucket: (1) texts of the same words in the same order are one class (by a 128-bit BLAKE2b of those words),
with the least doc_id as representative; (2) in each bucket every representative is compared, on full sets, with the least one; (3) in
buckets whose members are then not all connected, with the one that has most links so far (the original of many copies); (4) what is
still in several pieces (mostly texts that share a passage and no more) goes through a second, finer collection: 36 sub-hashes of 5
minhashes each, made for these texts only. There a pair at 0.8 is missed with probability 1.1e-5 and one at 0.3 shares a table with 0.004.
The least and the greatest piece of a table are known before anything is joined; pieces that share
tables, directly or over others, are a cell. In a cell the texts outside its largest piece are compared with each other and with that
piece, whose own texts are not compared again: both are cut into blocks, and a task compares two blocks. A cell of more than CELL_BLOCKS blocks, such as very many texts that
share a notice, is not compared as a whole: its texts meet in the tables that they share only, in the same way, so that their number counts once and not as a square. Two blocks are compared by sizes
and by 129 of 180 minhashes on two bits (a pair at 0.8 has fewer with probability 1e-6), then full sets, and gives only links that join pieces.
All links are confirmed on the texts themselves; a text that many are compared with is sent once for PART of them. Components come
from confirmed links.

Defined results: words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; distinct shingles of 4 words, a shorter text is one
shingle, null or wordless texts have none and stay alone; so does a row without a doc_id (its component_id is null, and it is kept). Rows repeated
under one doc_id are answered each for itself; links of any text of a doc_id hold for it. An empty table has no rows; other columns, whatever
their names, are neither read nor changed. A very long text is a slice by itself; its shingles are eight bytes each, and what is compared are its
whole sets, one pair at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, text
from .components import components

SHINGLE = 4
PERCENT = 80
#: Texts in a block of a cell, and shingles in it on average, at most; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: In a cell of more blocks than that, texts meet only in the tables that they share.
CELL_BLOCKS = 8
#: Texts that are compared with one text in a row; beyond, another part begins, which any task may take.
PART = 500


@dataclass(frozen=True)
class Collection:
    """m sub-hashes of t minhashes, the first being function number `first`; agree: of the m x t minhashes, how many must agree on two bits."""

    m: int
    t: int
    first: int
    agree: int

    def words(self) -> int:
        """64-bit words that hold two bits of every minhash."""
        return -(-self.m * self.t // 32)


COARSE = Collection(14, 2, 0, 0)
FINE = Collection(36, 5, 28, 129)

_RNG = np.random.default_rng(977)
_FUNCTIONS = COARSE.m * COARSE.t + FINE.m * FINE.t
_XOR = _RNG.integers(0, 2**63, _FUNCTIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, _FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SCHEMA = "doc_id long, n_shingles long, k1 long, k2 long, bits array<long>, subs array<long>, shingles array<long>"


def shingle_hashes(words: text.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, in turn, and their len(documents) + 1 offsets."""
    h = words.hashes()
    every = text.windows(h, k)
    out, first = [], np.zeros(len(words.count) + 1, dtype=np.int64)
    for i, n in enumerate(words.count.tolist()):
        if n >= k:
            own = np.sort(every[words.first[i] : words.first[i] + n - k + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        else:
            own = text.windows(h[words.first[i] : words.first[i] + n], n) if n else h[:0]
        out.append(own)
        first[i + 1] = len(own)
    return (np.concatenate(out) if out else h[:0]), np.cumsum(first)


def digests(words: text.Words) -> np.ndarray:
    """Two 64-bit halves of a BLAKE2b of each document's words, in order, one space between them."""
    keep = words.inside.copy()
    after_first = np.ones(len(words), dtype=bool)
    after_first[words.first[:-1][words.count > 0]] = False
    keep[words.start[after_first] - 1] = True
    joined = np.where(words.inside, words.bytes, np.uint8(0x20))[keep]
    bounds = np.append(0, np.cumsum(keep))[words.offsets].tolist()
    whole = joined.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)), "<i8").reshape(-1, 2)


def signatures(docs: DataFrame, k: int = SHINGLE, c: Collection = COARSE, with_shingles: bool = False) -> DataFrame:
    """Per row: size of the shingle set, a 128-bit digest of the words in order, two bits of each minhash, the sub-hashes of the collection, and if asked for the sorted shingle hashes."""

    def fixed(table: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(text.signed(np.ascontiguousarray(table).ravel())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                words = text.Words(*text.utf8(part.column(1)), text.SPACE_WORDS)
                sets, first = shingle_hashes(words, k)
                size = np.diff(first)
                full = np.flatnonzero(size)
                at = first[full]
                n = len(size)
                mins = np.zeros((n, c.m * c.t), dtype=np.uint64)
                if len(full):
                    for j in range(c.m * c.t):
                        v = (sets ^ _XOR[c.first + j]) * _MUL[c.first + j]
                        v ^= v >> np.uint64(32)
                        v *= _MUL[(c.first + j + 7) % _FUNCTIONS]
                        mins[full, j] = np.minimum.reduceat(v, at)
                subs = np.zeros((n, c.m), dtype=np.uint64)
                for j in range(c.t):
                    subs = text.mix(subs * np.uint64(0xC2B2AE3D27D4EB4F) + mins[:, j :: c.t])
                two = np.zeros((n, c.words() * 32), dtype=np.uint64)
                two[:, : c.m * c.t] = text.mix(mins) & np.uint64(3)
                bits = np.bitwise_or.reduce(two.reshape(n, -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)
                whole = digests(words)
                yield pa.record_batch({"doc_id": part.column(0), "n_shingles": size, "k1": np.ascontiguousarray(whole[:, 0]), "k2": np.ascontiguousarray(whole[:, 1]), "bits": fixed(bits), "subs": fixed(subs), "shingles": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(text.signed(sets))) if with_shingles else pa.nulls(n, pa.list_(pa.int64()))})

    return frames.doc_texts(docs).mapInArrow(run, SCHEMA)


def table_keys(c: Collection, subs: str = "subs") -> Column:
    """A key for every pair of sub-hashes."""
    sub = lambda i: F.element_at(subs, i + 1)
    if c.m <= 16:
        return F.array(*(F.xxhash64(F.lit(i * c.m + j), sub(i), sub(j)) for i in range(c.m) for j in range(i + 1, c.m)))
    every = F.sequence(F.lit(0), F.lit(c.m - 1))
    pairs = F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j > i), lambda j: F.xxhash64(i * c.m + j, F.element_at(subs, i + 1), F.element_at(subs, j + 1))))
    return F.flatten(pairs)


def shingle_set(value: str, k: int = SHINGLE) -> set[bytes]:
    """The set itself, as confirmed links see it."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", value.encode().translate(bytes(text.LOWER)))
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def confirm(pairs: DataFrame, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 x intersection >= percent x union. pairs is checkpointed and distinct.

    A text b goes once to each part of the texts that are compared with it, and stands before them; a task reads its rows in that order and
    holds the sets of one b and one a."""
    wanted = frames.compact(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = frames.doc_texts(docs).join(frames.maybe_broadcast(wanted, 16), "doc_id", "left_semi")
    many = frames.compact(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")).where("parts > 1"))
    dealt = pairs.join(frames.maybe_broadcast(many, 16), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).select("a", "b", "part")
    members = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "text")
    leads = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, seen = None, [], set()
        for batch in batches:
            good = []
            for b, part, a, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (b, part) != now:
                    now, sets, seen = (b, part), [], set()
                own = value.as_py()
                if a is None:  # a text of b; rows repeated under one doc_id may have several
                    if own not in seen:
                        seen.add(own)
                        sets.append(shingle_set(own, k))
                    good.append(False)
                    continue
                mine = shingle_set(own, k)
                good.append(any((shared := len(mine & x)) and 100 * shared >= percent * (len(mine) + len(x) - shared) for x in sets))
            yield batch.select([2, 0]).filter(pa.array(good, pa.bool_()))

    return leads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long").distinct()


def _agreeing(x: np.ndarray, y: np.ndarray, c: Collection) -> np.ndarray:
    """How many minhashes of every row of x and every row of y agree on their two bits."""
    total = np.full((len(x), len(y)), c.m * c.t, dtype=np.int16)
    for i in range(c.words()):
        d = x[:, None, i] ^ y[None, :, i]
        total -= np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555))
    return total


def _links_between(table: pa.Table, percent: int) -> pa.Table:
    """The links (a, b) of one pair of a cell's blocks that join different pieces."""
    lists = lambda name: table.column(name).combine_chunks()
    rep, n, piece, block = (table.column(c).to_numpy() for c in ("rep", "n", "component", "block"))
    lo = table.column("lo")[0].as_py()
    bits = lists("bits").flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
    first = np.append(0, np.cumsum(n))
    _, number = np.unique(lists("shingles").flatten().to_numpy(), return_inverse=True)
    left = np.flatnonzero(block == lo)
    right = left if table.column("hi")[0].as_py() == lo else np.flatnonzero(block != lo)
    a: list[int] = []
    b: list[int] = []
    if len(left) and len(right):
        likely = (_agreeing(bits[left], bits[right], FINE) >= FINE.agree) & (100 * np.minimum.outer(n[left], n[right]) >= percent * np.maximum.outer(n[left], n[right])) & (piece[left][:, None] != piece[right][None, :])
        # postings of the right block: which of its texts hold a shingle
        own = text.ragged(first[right], n[right])
        order = np.argsort(number[own], kind="stable")
        holder = np.repeat(np.arange(len(right)), n[right])[order]
        begin = np.searchsorted(number[own][order], np.arange(int(number.max()) + 2))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        for i in np.flatnonzero(likely.any(axis=1)).tolist():
            mine = number[first[left[i]] : first[left[i] + 1]]
            shared = np.bincount(holder[text.ragged(begin[mine], begin[mine + 1] - begin[mine])], minlength=len(right))
            good = likely[i] & (100 * shared >= percent * (n[left[i]] + n[right] - shared)) & (shared > 0)
            for j in np.flatnonzero(good).tolist():
                x, y = find(int(piece[left[i]])), find(int(piece[right[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    pair = int(rep[left[i]]), int(rep[right[j]])
                    a.append(max(pair))
                    b.append(min(pair))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open(members: DataFrame, pieces: DataFrame) -> DataFrame:
    """key, rep and component of the members of tables that are in several pieces."""
    with_piece = members.join(pieces, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = with_piece.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("key", "many")
    return frames.compact(with_piece.join(several, "key"))


def _pieces(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("rep"), "component")


def _dealt(members: DataFrame, unit: str) -> DataFrame:
    """The rows of members (unit, rep, node, component, n, bits, shingles) once for each pair of blocks (unit, lo, hi) of their unit that they are compared in, with their own block."""
    sizes = members.groupBy(unit, "component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    plan = _plan(sizes, unit)
    placed = members.join(frames.maybe_broadcast(frames.compact(plan), 40), unit).withColumn("block", F.when(F.col("component") == F.col("main"), F.col("small") + F.pmod("node", "large")).otherwise(F.pmod("node", "small")).cast("int"))
    # blocks 0 .. small - 1 meet each other and all of the main piece's, small .. small + large - 1
    last = F.when(F.col("block") < F.col("small"), F.col("small") + F.col("large") - 1).otherwise(F.col("small") - 1)
    return placed.withColumn("with", F.explode(F.sequence(F.lit(0), last))).withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).select(F.col(unit).alias("unit"), "lo", "hi", "block", "rep", "component", "n", "bits", "shingles")


def _plan(sizes: DataFrame, unit: str) -> DataFrame:
    """Of each unit its largest piece (main), and into how many blocks that (large) and all other texts (small) are dealt. sizes: unit, component, texts, shingles."""
    blocks = lambda texts, shingles: F.ceil(F.greatest(texts / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    largest = F.max_by(F.struct("component", "texts", "shingles"), F.struct("texts", "component"))
    plan = sizes.groupBy(unit).agg(largest.alias("main"), F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"))
    return plan.select(unit, F.col("main.component").alias("main"), blocks(F.col("texts") - F.col("main.texts"), F.col("shingles") - F.col("main.shingles")).alias("small"), blocks(F.col("main.texts"), F.col("main.shingles")).alias("large"))


def _compared(fine: DataFrame) -> list[DataFrame]:
    """The rows of fine (rep, node, component, n, bits, subs, shingles) that are to be compared, dealt to pairs of blocks: of whole cells, and of the single tables of cells of many blocks."""
    tables = fine.select("component", F.explode(table_keys(FINE)).alias("key"))
    # least and greatest piece are combined in the tasks; only tables of several pieces are looked at again
    several = frames.compact(tables.groupBy("key").agg(F.min("component").alias("lead"), F.max("component").alias("other")).where("lead <> other").select("key", "lead"))
    stars = frames.compact(tables.join(frames.maybe_broadcast(several, 24), "key").where("component <> lead").select(F.col("component").alias("a"), F.col("lead").alias("b")).distinct())
    cells = _pieces(stars).select(F.col("rep").alias("component"), F.col("component").alias("cell"))
    members = fine.join(frames.maybe_broadcast(frames.compact(cells), 16), "component")
    sizes = members.groupBy("cell", "component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    wide = frames.compact(_plan(sizes, "cell").where(F.col("small") > CELL_BLOCKS).select("cell"))
    if not wide.limit(1).count():
        return [_dealt(members.drop("subs"), "cell")]
    wide = frames.maybe_broadcast(wide, 16)
    in_tables = members.join(wide, "cell", "left_semi").withColumn("key", F.explode(table_keys(FINE))).drop("subs", "cell").join(frames.maybe_broadcast(several.select("key"), 16), "key", "left_semi")
    return [_dealt(members.drop("subs").join(wide, "cell", "left_anti"), "cell"), _dealt(in_tables, "key")]


def groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row of docs."""
    sig = frames.cut(signatures(docs, k))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = frames.cut(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("subs").alias("subs")))
    keyed = classes.select("rep", F.explode(table_keys(COARSE)).alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("other")).where("lead <> other").select("key", "lead")
    members = frames.compact(keyed.join(leaders, "key"))  # of tables with at least two representatives

    # against the least representative
    links = frames.compact(confirm(frames.compact(members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()), docs, k, percent))
    pieces = _pieces(links)
    rest = _open(members.select("key", "rep"), pieces).where("many > 2")

    # against the one with most links
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    hubs = rest.join(degree, "rep").groupBy("key").agg(F.max_by(F.struct("rep", "component"), F.struct("degree", -F.col("rep"))).alias("hub"))
    second = frames.compact(rest.join(hubs, "key").where("component <> hub.component").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct())
    if second.limit(1).count():
        links = frames.compact(links.unionByName(confirm(second, docs, k, percent)).distinct())
        pieces = _pieces(links)
        rest = _open(rest.select("key", "rep"), pieces)

    # the finer collection, for what is still in several pieces
    left = frames.compact(rest.select("rep").distinct())
    if left.limit(1).count():
        again = frames.doc_texts(docs).withColumnRenamed("doc_id", "rep").join(frames.maybe_broadcast(left, 16), "rep", "left_semi").withColumnRenamed("rep", "doc_id")
        # every text of a doc_id is a node of its own here; nodes that share a number only share a block
        fine = signatures(again, k, FINE, True).where("n_shingles > 0").groupBy(F.col("doc_id").alias("rep"), "k1", "k2").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("subs").alias("subs"), F.first("shingles").alias("shingles"))
        fine = frames.cut(fine.join(pieces, "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("node", F.xxhash64("rep", "k1", "k2")).drop("k1", "k2"))
        between = [rows.groupBy("unit", "lo", "hi").applyInArrow(lambda t: _links_between(t, percent), "a long, b long") for rows in _compared(fine)]
        third = frames.compact(reduce(DataFrame.unionByName, between).distinct())
        if third.limit(1).count():
            links = frames.compact(links.unionByName(confirm(third, docs, k, percent)).distinct())
            pieces = _pieces(links)

    of = classes.select("k1", "k2", "rep").join(pieces, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    linked = full.select("doc_id", "n_shingles", "k1", "k2").join(of, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_shingles, component_id and kept (it is its component's least doc_id)."""
    return groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that stay: one doc_id of each component (all its rows), texts without words, and rows without a doc_id."""
    return frames.without(docs, groups(docs, k, percent).where("doc_id <> component_id"))


def brute_force(rows: list[tuple[int, str | None]], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """The report by comparing all pairs, for tests."""
    sets = [shingle_set(t or "", k) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (n := len(a & sets[j])) and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[j : j + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as j from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id as c from documents union select e.v, r.c from r join e on e.u = r.doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from documents d left join n using (doc_id) join (select doc_id, min(c) as c from r group by doc_id) m on m.doc_id = d.doc_id
"""
