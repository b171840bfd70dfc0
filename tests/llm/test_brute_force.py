"""Queries that SQL can't express, held against plain Python: one document, one word, one edge at a time, without Spark, numpy or hashes of words."""

import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from escriba.llm import licenses, pii, quality, queries, toxicity

from .conftest import frame

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


# --- toxicity


def plain_sentences(t):
    """(start, end, words) of every sentence."""
    out, first = [], 0
    for m in [*re.finditer(r"[.!?\n]", t), None]:
        end = m.start() if m else len(t)
        at = [w.span() for w in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t[first:end]))]
        if at:
            out.append((first + at[0][0], first + at[-1][1], [t[first + a : first + b] for a, b in at]))
        first = end + 1
    return out


def test_toxicity_scores(spark, documents):
    model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert not model.empty
    weight = {}

    def worth(w):
        if w not in weight:
            weight[w] = float(sum(model.weights[b] for b in toxicity.sentences(pa.array([w])).features[0]))
        return weight[w]

    rows = queries.op1_toxicity(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        clean, sure, unsure = 1.0, set(), set()
        found = plain_sentences(documents[r.doc_id])
        for a, b, words in found:
            p = 1 / (1 + math.exp(-min(40, max(-40, model.bias + sum(map(worth, words))))))
            clean *= 1 - p
            if abs(p - toxicity.THRESHOLD) < 1e-3:
                unsure.add(f"{a}:{b}")
            elif p > toxicity.THRESHOLD:
                sure.add(f"{a}:{b}")
        assert r.score == pytest.approx(1 - clean, abs=1e-4) and r.predicted == (r.score >= toxicity.THRESHOLD) and r.n_sentences == len(found)
        assert sure <= set(filter(None, r.offending.split(","))) <= sure | unsure


def test_noisy_or_is_fitted_to_its_minimum():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(60), 4)
    known = [rng.choice(6, rng.integers(1, 4), replace=False) for _ in doc]
    feature, of = np.concatenate(known), np.repeat(np.arange(len(doc)), [len(k) for k in known])
    labels = np.array([int(any(0 in k for k in known[4 * d : 4 * d + 4]) or rng.random() < 0.1) for d in range(60)])

    def loss(w, bias):
        total = 0.0
        for d in range(60):
            clean = math.prod(1 - 1 / (1 + math.exp(-(bias + sum(w[k])))) for k in known[4 * d : 4 * d + 4])
            total -= math.log(max(1e-12, 1 - clean if labels[d] else clean))
        return (total + 0.5e-3 * float(w @ w)) / 60

    w, bias = toxicity.fit(feature, of, doc, labels, np.zeros(6), rounds=1500)
    best = loss(w, bias)
    for _ in range(300):
        step = rng.normal(size=7)
        step *= 0.4 / np.linalg.norm(step)
        assert loss(w + step[:-1], bias + step[-1]) > best - 1e-4
    assert w.argmax() == 0


# --- licenses


def plain_licenses(t, k=licenses.K):
    """The report's row by counting votes in a dictionary."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t))
    places, found = [], []
    for template in licenses.templates():
        size = len(template.words)
        votes = {}
        for i in range(len(w) - k + 1):
            for j in range(size - k + 1):
                if tuple(w[i : i + k]) == template.words[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        if template.base:
            places += [(template.label, d) for d, seen in votes.items() if len(seen) == size - k + 1]
            continue
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= licenses.NEAR:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            covered = {j + x for d in g for j in votes[d] for x in range(k)}
            if len(covered) < size * (licenses.SIMILAR - 0.1):
                continue
            a, b = max(0, min(d + min(votes[d]) for d in g)), min(len(w), max(d + max(votes[d]) + k for d in g))
            alike = lambda x, y, template=template: SequenceMatcher(None, template.words, w[x:y], autojunk=False).ratio()
            tried = [(x, y) for x, y in ((a, b), (a - 1, b), (a, b + 1), (a - 2, b), (a, b + 2)) if x >= 0 and y <= len(w)]
            x, y = max(tried, key=lambda s: alike(*s))
            if alike(x, y) >= licenses.SIMILAR:
                found.append((alike(x, y), x, y, template.label))
    chosen = []
    for s in sorted(found, key=lambda s: (-s[0], s[1] - s[2], s[1], s[3])):
        if not any(s[1] < o[2] and o[1] < s[2] for o in chosen):
            chosen.append(s)
    at = [d for _, d in places]
    joined = lambda names: ",".join(sorted(set(names)))
    return (
        len(w), len(places), min(at, default=None), max(at, default=None), joined(x for x, _ in places), joined([x for x, _ in places] + [s[3] for s in chosen]),
        1.0 if places else max((s[0] for s in chosen), default=0.0), ",".join(sorted(f"{s[3]}:{s[1]}:{s[2]}" for s in chosen)),
    )


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        i = rng.randrange(1, len(words) - 1)
        match rng.randrange(3):
            case 0:
                words[i] = f"n{rng.randrange(99)}"
            case 1:
                words.insert(i, f"n{rng.randrange(99)}")
            case _:
                del words[i]
    return words


def license_texts():
    """Every template as it is, and with words replaced, put in and left out, beside others of its family, in text."""
    rng = random.Random(17)
    every = licenses.templates()
    filler = lambda: [rng.choice(["the", "license", "under", "cc", "by", "of", "x1", "software", "2", "0"]) for _ in range(rng.randint(0, 12))]
    out = []
    for times in (0, 1, 1, 2, 3):
        out += [filler() + edited(rng, t.words, times if len(t.words) > 5 else 0) + filler() for t in every]
    out += [filler() + edited(rng, rng.choice(every[3:]).words, 1) + filler() + list(rng.choice(every).words) + list(rng.choice(every).words) + filler() for _ in range(60)]
    return [" ".join(x) for x in out]


def test_licenses_are_the_votes(spark, documents):
    texts = [*license_texts(), *documents.values()]
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    got = {r.doc_id: tuple(r[c] for c in columns) for r in licenses.report(frame(spark, list(enumerate(texts)))).collect()}
    for d, t in enumerate(texts):
        want = plain_licenses(t)
        assert got[d][:6] + got[d][7:] == want[:6] + want[7:] and got[d][6] == pytest.approx(want[6]), t
    for n, template in enumerate(licenses.templates()):
        if not template.base:
            assert got[n][5]  # as it is
        if len(template.words) >= 15:  # with one word replaced, put in or left out
            assert template.label in got[n + len(licenses.templates())][5].split(",")


# --- personal data


def plain_marginals(field, ns):
    """Damped loopy sum-product, one message at a time."""
    chain, skip = pii.edges(ns)
    own = [[sum(field.node[s][f] for f in pii.features(n)) for s in range(pii.STATES)] for n in ns]
    directed = []  # (from, to, potential of (state of from, state of to)); a message and the one back are neighbours
    for pairs, table in ((chain, field.chain), (skip, field.skip)):
        for a, b in pairs:
            directed += [(a, b, table), (b, a, table.T)]
    messages = [[0.0] * pii.STATES for _ in directed]
    for _ in range(pii.ROUNDS):
        new = []
        for e, (a, _, table) in enumerate(directed):
            sums = [own[a][s] + sum(m[s] for m, (_, to, _) in zip(messages, directed, strict=True) if to == a) - messages[e ^ 1][s] for s in range(pii.STATES)]
            out = [math.log(sum(math.exp(sums[s] + table[s][x] - max(sums)) for s in range(pii.STATES))) for x in range(pii.STATES)]
            new.append([0.5 * old + 0.5 * (x - max(out)) for old, x in zip(messages[e], out, strict=True)])
        messages = new
    result = []
    for i in range(len(ns)):
        belief = [own[i][s] + sum(m[s] for m, (_, to, _) in zip(messages, directed, strict=True) if to == i) for s in range(pii.STATES)]
        p = [math.exp(x - max(belief)) for x in belief]
        result.append([x / sum(p) for x in p])
    return result


def plain_added(t, field):
    base = [s for spans in pii.base_spans(t).values() for s in spans]
    ns = pii.nodes(t)
    added, unsure = [], False
    for n, p in zip(ns, plain_marginals(field, ns), strict=True):
        k = max(range(pii.STATES), key=lambda s: p[s])
        unsure |= any(abs(x - pii.SURE) < 1e-6 for x in p)
        if k == 0 or p[k] < pii.SURE or any(s < n.end and n.start < e for s, e in base):
            continue
        kind = pii.KINDS[k - 1]
        if added and added[-1][0] == kind == "phone" and n.start - added[-1][2] <= 3 and not any(added[-1][2] <= s < n.start for s, _ in base):
            added[-1] = (kind, added[-1][1], n.end)
        else:
            added.append((kind, n.start, n.end))
    return [x for x in added if pii._plausible(x[0], t[x[1] : x[2]])], unsure


def test_added_spans_are_the_messages(spark, documents):
    rng = random.Random(31)
    card, phone, mail = "4465758382889437", "+1 (319) 555-5132", "me.7@mail.example.com"
    rows = [(d, t) for d, t in documents.items() if len(pii.nodes(t)) <= 60]
    for i in range(120):
        bits = [card, phone, mail, "10.20.30.40", "version 2", "12 items", f"{card} 44657583828", "(319) 555-5132", "555-5132", "10.20.30.40.50", "page 7.", "and", "then", mail + "@"]
        rows.append((10**6 + i, rng.choice([" ", " and "]).join(rng.choice(bits) for _ in range(rng.randint(1, 9)))))
    rows += [(2 * 10**6 + i, f"{' '.join(rng.choice(bits[4:6]) for _ in range(i % 4))} {card} {10**10 + i} and {card} of {phone} {10**9 + i}, then {phone}") for i in range(40)]
    docs = frame(spark, rows)
    field = pii.train(docs)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    n_added = 0
    for d, t in rows:
        added, unsure = plain_added(t, field)
        if unsure:
            continue
        n_added += len(added)
        every = sorted([(pii.KINDS.index(k), s, e) for k, spans in pii.base_spans(t).items() for s, e in spans] + [(pii.KINDS.index(k), s, e) for k, s, e in added])
        assert got[d].spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in every) and got[d].n_added == len(added), t
    assert n_added > 20


# --- quality


def notice_words(w):
    """Words of phrases of notices, the leftmost first, those listed first before others."""
    phrases, i, n = [p.split() for p in quality._NOTICES], 0, 0
    while i < len(w):
        k = next((len(p) for p in phrases if w[i : i + len(p)] == p), 0)
        n, i = n + k, i + max(1, k)
    return n


def plain_kept(t):
    """The verdict by the rules as the module's docstring states them."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
    repeated = {i + j for i, x in enumerate(windows) if x in often for j in range(3)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False, None
    total = lost = 0
    before = []
    for line in t.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not own:
            continue
        chars = sum(len(x) for x in own)
        plain = " ".join(re.findall(r"\w+", line.lower()))
        fails = [
            line in before,
            len(own) >= 4 and sum(x in list("|>»·/-*•<:") for x in own) * 4 >= len(own),
            sum(c in "#*$%&|<>" for c in "".join(own)) * 10 >= chars,
            len(own) >= 4 and not re.search("[.!?:;…。！？।؟][\"'”’»)\\]}*_ \t\r]*$", own[-1]),
            len(own) < 30 and 4 * notice_words(plain.split()) >= len(own),
            sum(any(c.isalpha() for c in x) for x in own) >= 8 and "".join(own).upper() == "".join(own) and not any(c.islower() for c in line),
            len(own) >= 8 and len(set(own)) * 3 < len(own),
        ]
        before.append(line)
        total += chars
        lost += chars if any(fails) else 0
    return lost * 100 <= quality.LOSS_PERCENT * total, lost


def test_quality_verdicts(spark, documents):
    rng = random.Random(23)
    prose = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n)) + rng.choice([".", "!", "", ".)", ' ."', "…"])
    other = ["Home | News | Sport | Shop", "We use cookies, as you know.", "SIGN IN OR LEAVE THIS PLACE AT ONCE NOW, ALL.", "a b " * 5 + ".", "#### $$$ one.", "no end here at all", "same line again, as before.", "", "  ", "Enable-JavaScript please.", "> > · · a b"]
    rows = [(i, "\n".join(rng.choice([prose(rng.randint(1, 25)), rng.choice(other)]) for _ in range(rng.randint(1, 25)))) for i in range(300)]
    rows += [(10**6 + d, t) for d, t in documents.items() if len(t) < 40_000]
    seen = set()
    for r in quality.report(frame(spark, rows)).collect():
        kept, lost = plain_kept(dict(rows)[r.doc_id])
        assert r.kept == kept and lost in (None, r.lost_chars), dict(rows)[r.doc_id]
        seen.add((r.base_failed, r.kept))
    assert seen == {(True, False), (False, False), (False, True)}


def plain_nodes(t):
    """Stretches of characters that some kind may hold, with a digit or @, without the punctuation around them; character by character."""
    held = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
    out, i = [], 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] in held:
            j += 1
        a, b = i, j
        while b > a and t[b - 1] in "\"')]}>,;:!?.":
            b -= 1
        while a < b and t[a] in "\"'([{<,;:!?=":
            a += 1
        if a < b and any(c in "0123456789@" for c in t[i:j]):
            out.append((a, b, t[a:b]))
        i = max(j, i + 1)
    return out


def test_nodes_are_plain_stretches(documents):
    texts = [*documents.values()] + ["(+1) 555-01.23, x@y.z;a=12.34.56.78|b", "9" * 400 + " " + "x" * 400 + "7", "@ . 1) (2 é3 ٣ ４", ""]
    for t in texts:
        got = [(n.start, n.end, n.body) for n in pii.nodes(t)]
        assert got == plain_nodes(t)
        chain, skip = pii.edges(pii.nodes(t))
        assert chain == [(i, i + 1) for i in range(len(got) - 1) if got[i + 1][0] - got[i][1] <= 3]
        bodies = [b for _, _, b in got]
        # every token is joined to its last occurrence before
        for i, b in enumerate(bodies):
            if b.lower() in [x.lower() for x in bodies[:i]]:
                before = max(j for j in range(i) if bodies[j].lower() == b.lower())
                assert (before, i) in skip
