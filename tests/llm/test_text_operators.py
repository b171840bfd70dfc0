"""Toxicity, licenses, substring dedup, personal data and quality, on small fixtures and against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from escriba.llm import licenses, pii, quality, substring_dedup, toxicity

from .conftest import frame, words

# --- toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for d in range(700):
        bad = d % 5 == 0
        s = [words(rng, rng.randint(3, 12), 300) for _ in range(rng.randint(2, 12))]
        if bad:
            i = rng.randrange(len(s))
            s[i] += " " + rng.choice(["vile", "rotten", "grimfoo", "grimbar", "grimbaz"])
        rows.append((d, ". ".join(s) + "."))
        labels.append((d, None, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity(labelled):
    docs, labels, rows = labelled
    got = toxicity.report(docs, labels).collect()
    assert {r.doc_id: r.held_out for r in got} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows}
    out = [r for r in got if r.held_out]
    assert sum((r.doc_id % 5 == 0) == bool(r.predicted) for r in out) >= 0.97 * len(out)
    text = dict(rows)
    found = [text[r.doc_id][slice(*map(int, s.split(":")))] for r in got if r.doc_id % 5 == 0 for s in r.offending.split(",") if s]
    assert found and np.mean([bool(re.search("vile|rotten|grim", s)) for s in found]) > 0.95


def test_toxicity_edges(spark, labelled, edges, edge_rows, empty):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    got = toxicity.score(edges, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 and r.n_sentences == 0 for r in got if r.doc_id in (900, 901, 902))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.report(edges, none).collect()} == {0.0}
    assert toxicity.report(empty, none).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 5 = 0").count() < 10 < 500 < kept.count()


def test_labels_of_unknown_documents_take_no_place(spark, labelled):
    docs, labels, _ = labelled
    more = labels.unionByName(spark.range(10_000, 20_000).selectExpr("id as doc_id", "cast(null as int) as quality", "cast(id % 2 as int) as toxic"))
    sample = lambda given: {(r.doc_id, r.toxic) for r in toxicity._sample(docs, given, 20, 60).collect()}
    assert sample(more) == sample(labels) and len(sample(more)) == 80


def test_noisy_or():
    p = toxicity.noisy_or(np.log([1.0, 1 / 3]), np.array([0, 0]), 2)
    assert p == pytest.approx([1 - 0.5 * 0.75, 0])


# --- licenses


def test_licenses(spark, edges, edge_rows, empty):
    mit = "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"
    rows = [
        (1, "Released under the MIT License. cc by nc cc-by-nc CC BY NC"),
        (2, "x " * 50 + mit),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "the license of apache version 2; under mit the license"),
        (5, None),
        (6, "Apache License, Version 2.0"),
        (6, "Apache License, Version 2.0"),
    ]
    got = {r.doc_id: r for r in licenses.report(frame(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (4, 1, 11, "cc-by-nc,mit", 1.0)
    assert (got[2].labels, got[2].base_labels, got[2].n_base) == ("mit", "", 0) and 0.8 < got[2].score < 1 and got[2].spans.startswith("mit:50:")
    assert got[3].labels == "gpl-3" and got[4].labels == "" and got[4].score == 0
    assert got[5].n_words == 0 and got[5].first_word is None
    assert got[6].base_labels == "apache-2" and got[6].n_base == 1
    assert licenses.report(edges).count() == len(edge_rows) and licenses.report(empty).count() == 0


def test_base_phrases_are_brute_forces(spark):
    rng = random.Random(9)
    bits = ["under the mit", "license", "apache license version 2", "cc by nc", "cc", "by", "nc", "the", "Version", "2.0"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.report(frame(spark, rows)).collect()}
    for d, t in rows:
        w = re.findall("[a-z0-9]+", t.lower())
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert got[d] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))


# --- substring dedup


def test_substring_dedup(spark, edges, edge_rows, empty):
    rng = random.Random(5)
    passage = ". ".join(words(rng, 9, 10**6) for _ in range(8)) + "."
    rows = [(i, f"{words(rng, 20, 10**6)}. {passage if i % 3 else ''} {words(rng, 15, 10**6)}!\nEnd.") for i in range(40)]
    rows += [(100, passage.upper()), (101, passage + "\n" + passage), (102, None), (103, ""), (104, "no. end"), (105, "no. end"), (106, "  \n")]
    got = sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in substring_dedup.remove(frame(spark, rows)).collect())
    assert got == sorted(substring_dedup.brute_force(rows))
    assert sum(passage.split(". ")[4] in t for _, t, _, _ in got) == 1
    assert substring_dedup.remove(edges).count() == len(edge_rows) and substring_dedup.remove(empty).count() == 0


def lost_windows(rows, got, sure=51):
    """Windows of so many words that occur earlier, too, and of which no word was removed."""
    gone = {r.doc_id: {k for x in r.removed.split(",") if x for k in range(*map(int, x.split(":")))} for r in got}
    seen, lost, repeats = set(), [], 0
    for d, t in sorted(rows):
        w = (t or "").split()
        for i in range(len(w) - sure + 1):
            key = tuple(w[i : i + sure])
            if key in seen:
                repeats += 1
                if gone[d].isdisjoint(range(i, i + sure)):
                    lost.append((d, i))
            seen.add(key)
    return lost, repeats


def test_substring_dedup_finds_every_long_passage(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for size in (51, 60, 500):
        for ends in (0, 0.02, 0.05, 0.1, 0.3):  # no sentences, long ones, short ones
            passage = "".join(x + (rng.choice([".", "!", "?"]) if rng.random() < ends else "") + " " for x in words(rng, size, 10**6).split()).strip()
            for left, right in (("", ""), (".", "."), ("", "."), (".", ""), (",", "\n")):
                rows.append((n, f"{words(rng, rng.randint(1, 90), 10**6)}{left} {passage}{right} {words(rng, rng.randint(1, 90), 10**6)}"))
                n += 1
    rows.append((n, rows[10][1].replace(".", "") + " " + rows[10][1]))
    got = substring_dedup.remove(frame(spark, rows)).collect()
    lost, repeats = lost_windows(rows, got)
    assert repeats > 5000 and not lost
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == sorted(substring_dedup.brute_force(rows))
    once = " ".join(f"v{i}" for i in range(500))  # without sentences pieces leave no gap
    r = substring_dedup.remove(frame(spark, [(1, once), (2, f"{words(rng, 9)} {once} {words(rng, 9)}")])).where("doc_id = 2").collect()[0]
    assert r.removed.count(":") == 1 and len(r.text.split()) <= 18 + 50 and r.n_removed == 1


def test_substring_dedup_decides_in_chunks(spark):
    """Few spans in a chunk or all in one: the same result; texts that share a doc_id, repeated rows, rows without a doc_id."""
    rng = random.Random(21)
    passage = " ".join(words(rng, 9, 10**6) + "." for _ in range(9))
    rows = [(i % 7, passage + " " + words(rng, 40, 10**6)) for i in range(20)] + [(3, passage), (3, passage), (1, "short text"), (1, words(rng, 60, 10**6)), (None, passage), (9, "the end.\n" * 30)]
    want = sorted(substring_dedup.brute_force(rows), key=str)
    for chunk in (1, 50, 1 << 20):
        got = substring_dedup.remove(frame(spark, rows).repartition(3), chunk=chunk).collect()
        assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got), key=str) == want


def test_substring_dedup_takes_one_long_sentence(spark):
    rng = random.Random(6)
    s = words(rng, 30, 10**6) + "."
    rows = [(i, f"{words(rng, 20, 10**6)}. {s} {words(rng, 20, 10**6)}.") for i in range(3)]
    assert [s in r.text for r in substring_dedup.remove(frame(spark, rows)).orderBy("doc_id").collect()] == [True, False, False]


# --- personal data


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15],
    }


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789012345..@@+-- ()ab_é%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t)
    long = "1" * 200_000 + "." + "a" * 200_000 + "@" + "+" * 1000
    assert pii.base_spans(long)["ip"] == []


def test_field_spreads_labels(spark, edges, edge_rows, empty):
    rng = random.Random(2)
    card = "4465758382889437"
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = []
    for i in range(300):
        kind = rng.choice(["me.7@mail.example.com", "10.20.30.40", card, "+1 (319) 555-5132", "version 2", "12 items", "page 7."])
        rows.append((i, f"{words(rng, 6).translate(letters)} {kind} tail"))
    rows += [(400, f"call +1 (319) 555-5132 soon, or {card} 44657583828 then {card}"), (401, None), (402, "")]
    field = pii.train(frame(spark, rows))
    got = {r.doc_id: r for r in pii.report(frame(spark, rows)).collect()}
    t = dict(rows)
    for d, r in got.items():
        base = plain_spans(t[d] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS) and r.base_sha256 == pii.digest(base)
        assert {f"{k}:{s}:{e}" for k in base for s, e in base[k]} <= set(r.spans.split(","))
        assert r.n_added == 0 or d == 400
    at = t[400].index(card)
    assert f"card:{at}:{at + 16}" in got[400].spans.split(",")  # the pattern took more digits along and failed
    assert pii.report(edges).count() == len(edge_rows) and pii.report(empty).count() == 0
    masked = {r.doc_id: r for r in pii.redact(frame(spark, rows), field).collect()}
    assert masked[400].text == "call [PHONE] soon, or [CARD] 44657583828 then [CARD]" and masked[401].text is None
    assert all(r.n_chars == len(r.text) for r in masked.values() if r.text is not None)


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.STATES, pii.N_FEATURES)), rng.normal(size=(pii.STATES,) * 2), np.eye(pii.STATES))
    on = (rng.random((3, pii.N_FEATURES)) < 0.3).astype(float)
    own = on @ field.node.T
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + field.chain[:, :, None] + field.skip[None, :, :])
    want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    got = pii.marginals(field, on, np.array([[0, 1]]), np.array([[1, 2]]), 60)
    assert np.allclose(got, np.array(want) / joint.sum())


# --- quality


def plain_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(spark, edges, edge_rows, empty):
    rng = random.Random(1)
    rows = [(i, "\n".join(" ".join(rng.choice(["a", "b", "c#", "d|", "eé", "f"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(500, None), (501, "a b c " * 30), (502, "\r\n \n")]
    got = {r.doc_id: r for r in quality.report(frame(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t or ""), d
        assert not (r.base_failed and r.kept)
    assert quality.report(edges).count() == len(edge_rows) and quality.report(empty).count() == 0


def test_line_rules():
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    assert quality.judge(prose).kept
    menu = "Home | News | Sport | Shop | Login | Help"
    v = quality.judge(menu + "\n" + prose)
    assert v.kept and v.cleaned == prose
    assert not quality.judge("\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(9))).kept
    assert not quality.judge(" ".join(f"w{i}%%%" for i in range(70))).kept
    assert not quality.judge(" ".join(f"W{i}ORD" for i in range(70))).kept
