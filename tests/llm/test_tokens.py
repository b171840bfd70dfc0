import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from escriba.llm import byte_bpe, range_coder, text, token_count, token_files, word_bpe

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORD)
RANKS = byte_bpe.load_ranks(BYTE)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

CHARS = st.text(st.one_of(st.sampled_from("'''  sStTrReEvVmMlLdD09½²\n\t\r\x85\xa0.-|<"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"])), max_size=40)
TEXTS = st.lists(st.one_of(CHARS, st.text(st.characters(max_codepoint=0x2FF), max_size=40)), min_size=1, max_size=12)


@pytest.fixture(scope="module")
def word_encoder():
    spec = word_bpe.load(WORD)
    return word_bpe.Encoder(spec, word_bpe.prove_whole(spec))


@pytest.fixture(scope="module")
def byte_encoder():
    return byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def parts(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@settings(max_examples=120, deadline=None)
@given(TEXTS)
def test_word_ids_are_the_librarys(word_encoder, texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert parts(*word_encoder.encode(pa.array(texts))) == want
    assert word_encoder.counts(pa.array(texts))[0].tolist() == [len(x) for x in want]


@settings(max_examples=120, deadline=None)
@given(TEXTS)
def test_byte_ids_are_the_librarys(byte_encoder, texts):
    want = [TIKTOKEN.encode_ordinary(t) for t in texts]
    ids, n = byte_encoder.encode(pa.array(texts))
    assert parts(ids, n) == want
    raw, offsets = byte_encoder.decode(ids, n)
    assert [raw[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [t.encode() for t in texts]


HARD = ["it’s “quoted” — and the house is big", "日本語のテキスト 中文 ٣٤ ½ ²", "ΣΑΣ Ὀδυσσεύς ΟΔΟΣ", "e\u0301 İI ı ŞŞ ǆ ǅ", "😀😀 👩‍👩‍👧 the\u2003house\u3000is\u00a0big", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|", "\u1e9e ﬁ Å K \U0001e900\U00010400 \U00011383\U000113c2"]


def test_hard_texts_take_the_method(word_encoder, byte_encoder):
    column = pa.array(HARD + ["plain"])
    n, direct = word_encoder.counts(column)
    assert n.tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in HARD] + [1]
    assert direct[0] >= 6 and direct[4] >= 3 and direct[5] >= 4
    assert parts(*byte_encoder.encode(column)) == [TIKTOKEN.encode_ordinary(t) for t in HARD] + [TIKTOKEN.encode_ordinary("plain")]


def test_every_code_point(word_encoder, byte_encoder):
    rng = random.Random(3)
    some = [chr(c) for c in rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 6000)] + [chr(c) for c in range(0x300, 0x3000, 3)]
    texts = [f"ab{c}cd 12{c}3 {c} !{c}! {c}{c}{c}'s" for c in some]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        assert parts(*word_encoder.encode(pa.array(part))) == [e.ids for e in LIBRARY.encode_batch(part, add_special_tokens=False)]
        assert parts(*byte_encoder.encode(pa.array(part))) == [TIKTOKEN.encode_ordinary(t) for t in part]


def test_long_words_that_differ_by_an_exchange(word_encoder, byte_encoder):
    rng = random.Random(5)
    a = "".join(rng.choice("etaoinsr") for _ in range(70_000))
    b = list(a)
    j = next(j for j in range(100, 1000) if a[j] != a[j + 65_536])
    b[j], b[j + 65_536] = b[j + 65_536], b[j]
    texts = [a, "".join(b), a[:5000], a[:4999] + "q"]
    assert parts(*word_encoder.encode(pa.array(texts))) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    ids, n = byte_encoder.encode(pa.array(texts))
    raw, offsets = byte_encoder.decode(ids, n)
    assert [raw[x:y].tobytes().decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == texts
    assert len({tuple(x) for x in parts(ids, n)}) == 4


def test_clashing_hashes_are_not_believed(monkeypatch):
    plain = text.fingerprints

    def weak(*a):
        h, check = plain(*a)
        return h & np.uint64(15), check

    monkeypatch.setattr(text, "fingerprints", weak)
    e = word_bpe.Encoder(word_bpe.load(WORD))
    for t in ("the house of the big red fox isn't here, the house is there", "another house 12 fox unbelievably nonmagnetic"):
        assert e.encode(pa.array([t, t]))[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids * 2


def test_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMORY", 5)
    e = word_bpe.Encoder(word_bpe.load(WORD))
    for t in ("one two three four five six", "six seven one", "don't"):
        assert e.encode(pa.array([t]))[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_whole_tokens_are_proven():
    whole = word_bpe.prove_whole(word_bpe.load(WORD))
    assert len(whole) > 30_000
    for w in random.Random(1).sample(sorted(whole), 200):
        ids = LIBRARY.encode(w, add_special_tokens=False).ids
        assert whole[w] in ids and (len(ids) == 1 or not w.isalpha())


def test_prefixes(byte_encoder):
    rng = random.Random(6)
    some = lambda n: bytes(rng.choice(b"etaoinshr \xc3\xa9") for _ in range(rng.randint(0, n)))
    for _ in range(150):
        p = byte_bpe.Prefixes(byte_encoder.bpe, some(120))
        for _ in range(4):
            a = rng.randint(0, len(p.piece))
            b = rng.randint(a, min(len(p.piece), a + 6))
            p.edit(a, b, some(6))
            p.append(some(4))
            assert p.last == byte_encoder.bpe.last_tokens(p.piece)
            assert p.ids() == TIKTOKEN._encode_single_piece(p.piece)
    p = byte_bpe.Prefixes(byte_encoder.bpe, b"the quick brown fox " * 200)
    p.computed = 0
    p.edit(10, 11, b"x")
    assert p.computed < 200


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 49407) | st.integers(0, 3), max_size=600), st.integers(1, 40))
def test_coder_round_trip(ids, times):
    ids = np.array(ids * times, dtype=np.uint32)
    assert (range_coder.decode(range_coder.encode(ids)) == ids).all()


def test_coder_learns_and_checks():
    ids = np.array([5, 9, 1000, 7, 7, 3] * 20_000, dtype=np.uint32)
    block = range_coder.encode(ids)
    assert len(block) < len(ids) / 2
    for bad in (block[:-2], block[:40] + b"\0\0\0\0" + block[44:], b"NONE" + block[4:]):
        with pytest.raises(ValueError):
            range_coder.decode(bad)
    for most in (1 << 17) - 1, 1 << 17, 250_000, (1 << 32) - 1:
        some = np.append(np.random.default_rng(most).integers(0, most, 3000, dtype=np.uint32), [most, 0, most]).astype(np.uint32)
        assert (range_coder.decode(range_coder.encode(some)) == some).all()
    wide = np.random.default_rng(3).integers(0, 1 << 32, 70_000, dtype=np.uint32)  # more listed ids than 2^16
    assert (range_coder.decode(range_coder.encode(wide)) == wide).all()


def test_blocks_of_text_are_smaller_than_order_0(word_encoder):
    """Of the driver's documents: fewer bytes than the entropy of the ids' own frequencies, which a static code would have to be told besides."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.concatenate([word_encoder.encode(pa.array(rows[k : k + 400]))[0] for k in range(0, 3200, 400)]).astype(np.uint32)[: 1 << 21]
    n = np.bincount(ids)
    n = n[n > 0]
    block = range_coder.encode(ids)
    assert len(block) < -(n * np.log2(n / len(ids))).sum() / 8 * 0.97
    assert (range_coder.decode(block) == ids).all()


def test_counts(edges, edge_rows, empty):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.report(edges, WORD).collect())
    size = lambda t: len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((d, len((t or "").encode()), size(t), size(t) > 2048) for d, t in edge_rows)
    assert token_count.report(empty, WORD).count() == 0


def test_files(spark, edges, edge_rows, empty, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(edges, WORD, path, block_ids=5_000)
    assert spark.read.parquet(path).count() > 2
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect())
    want, at = [], 0
    for d, t in sorted(edge_rows, key=lambda x: (x[0], x[1] or "")):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.report(empty, WORD).count() == 0


def test_byte_report(edges, edge_rows, empty):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(d, len(ids := TIKTOKEN.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in edge_rows]
    got = [tuple(r) for r in byte_bpe.report(edges, BYTE, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert byte_bpe.report(empty, BYTE, public_tokenizers.PATTERN, True).count() == 0
