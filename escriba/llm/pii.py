"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the stretches of tokens (between white space, cut at characters that no kind may hold) with a digit or @. Three kinds of edges: chain edges between neighbouring
tokens (a telephone number has several), skip edges between a token and its last occurrence before, and between tokens
with the same last seven digits, at any distance; tokens that recur are joined one to the next, so edges grow as nodes do.
Loopy sum-product message passing gives each token's label probabilities, so that what is plain in one place decides about
the same token in another. Weights come from pseudo-likelihood on a bounded sample of documents, whose labels are the base
spans (distant supervision).

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; base spans always stay, an
added span never overlaps one; without a sample (no digits in the corpus) nothing is added; repeated rows, and rows without a
doc_id, are answered each for itself (a null doc_id doesn't teach). An empty table has no rows. redact returns all columns, whatever their names;
only text and n_chars (if there is one) change. A slice's nodes are held in memory: as many as its texts have tokens with a digit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

KINDS = ("email", "ip", "card", "phone")
#: Documents from which the weights are learned: those with the smallest hashes of doc_id among those with a digit or @.
SAMPLE_DOCS = 3_000
#: Least probability of an added span, and rounds of messages.
SURE, ROUNDS = 0.7, 8
#: What equal labels of recurring tokens are worth before training.
AGREE = 2.0
#: Documents with more nodes than this don't teach; all are searched.
TEACH_NODES = 200
#: Tokens are cut at characters that no kind may hold; every stretch with a digit or @ is a node, however long its token is.
_STRETCH = re.compile(r"[A-Za-z0-9._%+@()-]+")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a pattern that fails at a run of digits fails at every later digit of it, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = str.maketrans("", "", " ().-+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(value: str) -> list[tuple[int, int]]:
    """The part before @ is all of the run of its characters, and holds no @ itself: so every @ is tried once."""
    out, free, at = [], 0, value.find("@")
    while at >= 0:
        start = at
        while start > free and value[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(value, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = value.find("@", max(free, at + 1))
    return out


def base_spans(value: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in value:
        out["email"] = _emails(value)
    if _DIGIT.search(value):
        out["ip"] = [m.span() for m in _IP.finditer(value) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(value):
            d = m[0].translate(_DIGITS)
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in value:
            out["phone"] = [m.span() for m in _PHONE.finditer(value) if 9 <= len(m[0].translate(_DIGITS)) <= 15]
    return out


# --- nodes, features, edges

_TRIM_LEFT, _TRIM_RIGHT = "\"'([{<,;:!?=", "\"')]}>,;:!?."
N_FEATURES = 40


@dataclass
class Node:
    start: int
    end: int
    body: str
    before: str
    after: str


def nodes(value: str) -> list[Node]:
    """Stretches of tokens with a digit or @, without the punctuation around them."""
    out = []
    for m in _NODE.finditer(value):
        for x in _STRETCH.finditer(m[0]):
            a, b = x.start() + m.start(), x.end() + m.start()
            token = x[0]
            if "@" not in token and not _DIGIT.search(token):
                continue
            body = token.rstrip(_TRIM_RIGHT)
            lead = len(body) - len(body.lstrip(_TRIM_LEFT))
            body = body[lead:]
            if body:
                start = a + lead
                out.append(Node(start, start + len(body), body, value[max(0, a - 3) : start], value[start + len(body) : b + 3]))
    return out


def features(node: Node) -> list[int]:
    """Numbers of the features that are on, of N_FEATURES."""
    b = node.body
    d = sum("0" <= c <= "9" for c in b)
    letters = sum(c.isalpha() for c in b)
    dots = b.count(".")
    on = [0, 1 + min(7, (0, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 5, 6, 7)[min(d, 13)])]
    if d >= 20:
        on.append(9)
    on.append(10 + min(4, dots))
    if "@" in b:
        name, _, host = b.rpartition("@")
        on.append(15 if name and "." in host.strip(".") else 16)
    if letters:
        on.append(17 if letters > d else 18)
    else:
        on.append(19)
    if "-" in b:
        on.append(20)
    if b.startswith("+"):
        on.append(21)
    if node.before.endswith("("):
        on.append(22)
    if node.before.rstrip("(").endswith((")", "-", ".")) or node.before[-2:-1] in ")0123456789":
        on.append(23)
    if node.after[:1] == ")":
        on.append(24)
    if any("0" <= c <= "9" for c in node.after):
        on.append(25)
    if any("0" <= c <= "9" for c in node.before):
        on.append(26)
    plain = b.translate(_DIGITS)
    if plain.isdigit() and plain.isascii():
        on.append(27)
        if 13 <= len(plain) <= 19:
            on.append(28 if luhn(plain) else 29)
        elif 9 <= len(plain) <= 12:
            on.append(30)
        elif len(plain) in (7, 8):
            on.append(31)
    parts = b.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        on.append(32 if all(len(p) <= 3 and int(p) <= 255 for p in parts) else 33)
    if "=" in node.before or '"' in node.before:
        on.append(34)
    if "/" in b or ":" in b:
        on.append(35)
    return on


def similar_keys(node: Node) -> list[str]:
    """Nodes with a common key are joined by skip edges."""
    digits = "".join(c for c in node.body if "0" <= c <= "9")
    return ["=" + node.body.lower(), *(["#" + digits[-7:]] if len(digits) >= 7 else [])]


def edges(ns: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (neighbours, one space or less apart) and skip edges (a key's occurrences, one to the next)."""
    chain = [(i, i + 1) for i in range(len(ns) - 1) if ns[i + 1].start - ns[i].end <= 3]
    last: dict[str, int] = {}
    skip = []
    for i, n in enumerate(ns):
        for k in similar_keys(n):
            if k in last and (last[k], i) not in skip[-2:]:
                skip.append((last[k], i))
            last[k] = i
    return chain, skip


def labels_of(ns: list[Node], base: dict[str, list[tuple[int, int]]]) -> list[int]:
    """0, or 1 + the kind of the base span that a node overlaps (the first kind listed, if several)."""
    out = [0] * len(ns)
    for k in range(len(KINDS) - 1, -1, -1):
        spans, j = base[KINDS[k]], 0
        for i, n in enumerate(ns):
            while j < len(spans) and spans[j][1] <= n.start:
                j += 1
            if j < len(spans) and spans[j][0] < n.end:
                out[i] = k + 1
    return out


def teaching_labels(ns: list[Node], base: dict[str, list[tuple[int, int]]]) -> list[int]:
    """labels_of, where a token without a label takes that of an equal token of the document: it is no example of what is not personal."""
    own = labels_of(ns, base)
    known = {n.body.lower(): k for n, k in zip(ns, own, strict=True) if k}
    return [k or known.get(n.body.lower(), 0) for n, k in zip(ns, own, strict=True)]


# --- the field

STATES = 1 + len(KINDS)


@dataclass
class Field:
    """Log potentials. node: STATES x N_FEATURES; chain, skip: STATES x STATES."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(on: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 250, l2: float = 0.02) -> Field:
    """Pseudo-likelihood: each label given its features and its neighbours' labels. Weights are drawn to 0, those of skip edges to AGREE for equal labels, which holds where a sample has few recurring tokens. on: nodes x N_FEATURES; chain, skip: edges x 2."""
    n = max(1, len(labels))
    left, right, far = np.zeros((n, STATES)), np.zeros((n, STATES)), np.zeros((n, STATES))
    np.add.at(left, (chain[:, 1], labels[chain[:, 0]]), 1)
    np.add.at(right, (chain[:, 0], labels[chain[:, 1]]), 1)
    for a, b in ((0, 1), (1, 0)):
        np.add.at(far, (skip[:, a], labels[skip[:, b]]), 1)
    x = np.hstack([on, left, right, far])
    y = np.eye(STATES)[labels]
    f, s = N_FEATURES, STATES
    prior = np.zeros((STATES, x.shape[1]))
    prior[:, f + 2 * s :] = AGREE * np.eye(STATES)
    w = prior.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y).T @ x / n + l2 * (w - prior) / n * 10
        # an edge's two ends share its potential, and a skip edge has no direction
        c = g[:, f : f + s] + g[:, f + s : f + 2 * s].T
        g[:, f : f + s], g[:, f + s : f + 2 * s] = c, c.T
        k = g[:, f + 2 * s :]
        g[:, f + 2 * s :] = k + k.T
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Field(w[:, :f], w[:, f : f + s].T.copy(), w[:, f + 2 * s :])


def marginals(field: Field, on: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of all nodes (of many documents at once) by loopy sum-product, damped by half."""
    own = on @ field.node.T
    if not len(own):
        return own
    table = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
    both = np.concatenate([chain, skip])
    if len(both):
        source, target = np.concatenate([both[:, 0], both[:, 1]]), np.concatenate([both[:, 1], both[:, 0]])
        pair = np.concatenate([table, table.transpose(0, 2, 1)])  # source state x target state
        back = np.concatenate([np.arange(len(both)) + len(both), np.arange(len(both))])
        messages = np.zeros((len(source), STATES))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, target, messages)
            out = (total[source] - messages[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
        own = own.copy()
        np.add.at(own, target, messages)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _graph(docs: list[list[Node]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = sum(map(len, docs))
    on = np.zeros((total, N_FEATURES))
    chain, skip, base = [], [], 0
    for ns in docs:
        for i, n in enumerate(ns):
            on[base + i, features(n)] = 1
        c, s = edges(ns)
        chain += [(a + base, b + base) for a, b in c]
        skip += [(a + base, b + base) for a, b in s]
        base += len(ns)
    shape = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    return on, shape(chain), shape(skip)


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Field | None:
    """Weights from at most so many documents, whose nodes (TEACH_NODES of each at most, or the document teaches nothing) with features, labels and edges the driver gets."""
    texts = frames.doc_texts(docs).where(F.col("text").rlike("[0-9@]"))
    chosen = texts.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                values = part.column(1).to_pylist()
                every = [ns if len(ns := nodes(t)) <= TEACH_NODES else [] for t in values]
                joined = [edges(ns) for ns in every]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "label": [teaching_labels(ns, base_spans(t)) for ns, t in zip(every, values, strict=True)],
                        "on": pa.array([[features(n) for n in ns] for ns in every], pa.list_(pa.list_(pa.int32()))),
                        "chain": pa.array([[x for e in chain for x in e] for chain, _ in joined], pa.list_(pa.int32())),
                        "skip": pa.array([[x for e in skip for x in e] for _, skip in joined], pa.list_(pa.int32())),
                    },
                    schema=pa.schema([("doc_id", pa.int64()), ("label", pa.list_(pa.int32())), ("on", pa.list_(pa.list_(pa.int32()))), ("chain", pa.list_(pa.int32())), ("skip", pa.list_(pa.int32()))]),
                )

    one = texts.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))  # rows of one doc_id are one example
    rows = one.mapInArrow(run, "doc_id long, label array<int>, on array<array<int>>, chain array<int>, skip array<int>").orderBy("doc_id").collect()
    labels = np.array([x for r in rows for x in r["label"]], dtype=np.int64)
    if not len(labels):
        return None
    on = np.zeros((len(labels), N_FEATURES))
    chain, skip, base = [], [], 0
    for r in rows:
        for i, f in enumerate(r["on"]):
            on[base + i, f] = 1
        for to, name in ((chain, "chain"), (skip, "skip")):
            to += [x + base for x in r[name]]
        base += len(r["label"])
    shape = lambda x: np.array(x, dtype=np.int64).reshape(-1, 2)
    return fit(on, labels, shape(chain), shape(skip))


def _plausible(kind: str, body: str) -> bool:
    """What an added span must have, whatever its probability."""
    digits = sum("0" <= c <= "9" for c in body)
    if kind == "email":
        name, _, host = body.rpartition("@")
        return bool(name) and bool(host)
    if any(c.isalpha() for c in body):
        return False
    if kind == "ip":
        return body.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in body.split("."))
    return 12 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def find(values: list[str], field: Field | None) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Of each text: base spans by kind, and added spans (kind, start, end)."""
    base = [base_spans(t) for t in values]
    if field is None:
        return [(b, []) for b in base]
    every = [nodes(t) if "@" in t or _DIGIT.search(t) else [] for t in values]
    p = marginals(field, *_graph(every))
    out, at = [], 0
    for t, b, ns in zip(values, base, every, strict=True):
        taken: list[tuple[int, int]] = []  # what base spans cover, overlapping ones as one
        for s, e in sorted(s for spans in b.values() for s in spans):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        added: list[tuple[str, int, int]] = []
        j = 0
        for n in ns:
            row, at = p[at] if len(p) else None, at + 1
            while j < len(taken) and taken[j][1] <= n.start:
                j += 1
            k = int(row.argmax())
            if k and row[k] >= SURE and not (j < len(taken) and taken[j][0] < n.end):
                kind = KINDS[k - 1]
                if added and kind == "phone" == added[-1][0] and n.start - added[-1][2] <= 3 and not (j and taken[j - 1][1] > added[-1][1]):
                    added[-1] = (kind, added[-1][1], n.end)
                else:
                    added.append((kind, n.start, n.end))
        out.append((b, [x for x in added if _plausible(x[0], t[x[1] : x[2]])]))
    return out


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, text, base and added: arrays of struct(kind, start, end), by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some hundred weights
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1]))]
        for batch in batches:
            for part in text.slices(batch):
                found = find(part.column(1).to_pylist(), shared.value)
                yield pa.record_batch({"doc_id": part.column(0), "base": pa.array([show([(k, s, e) for k, v in b.items() for s, e in v]) for b, _ in found], span), "added": pa.array([show(a) for _, a in found], span)})

    s = "array<struct<kind:string,start:long,end:long>>"
    return frames.doc_texts(docs).mapInArrow(run, f"doc_id long, base {s}, added {s}")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base spans of each kind, the digest of the base spans, and all spans as kind:start:end."""
    show = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    of = lambda k: F.array_sort(F.filter(F.concat("base", "added"), lambda x: x["kind"] == k))
    return scan(docs, train(docs)).select("doc_id", *(count(k) for k in KINDS), F.sha2(show(F.col("base")).cast("binary"), 256).alias("base_sha256"), show(F.concat(*(of(k) for k in KINDS))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def base_report(docs: DataFrame) -> DataFrame:
    """Of the report, what the base patterns alone decide."""
    return report(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256")


def masked(value: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the stretch they cover together, once."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [value[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, value[at:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs, all columns, with the spans of text masked; n_chars, if there is one, is the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for rows, texts in text.rows_with_text(batch):
                values = texts.to_pylist()
                new = [masked(t, [*((k, s, e) for k, v in b.items() for s, e in v), *a]) for t, (b, a) in zip(values, find(values, shared.value), strict=True)]
                missing = rows.column(at).is_null().to_pylist()
                yield rows.set_column(at, rows.schema.field(at), pa.array([None if m else t for t, m in zip(new, missing, strict=True)], rows.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(out.dtypes)["n_chars"])) if "n_chars" in names else out


def digest(spans: dict[str, list[tuple[int, int]]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]).encode()).hexdigest()


def _places_sql(pattern: str) -> str:
    """Matches and their starts: what lies between the matches tells where they are."""
    return f"""(select list_transform(range(1, len(m) + 1), lambda k: {{'m': m[k], 's': cast(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as bigint)}})
  from (select regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as gaps) p)"""


_TEN = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(range(1, length({_TEN}) + 1), lambda i: case when (length({_TEN}) - i) % 2 = 0 then cast({_TEN}[i] as int) else cast({_TEN}[i] as int) * 2 - case when cast({_TEN}[i] as int) > 4 then 9 else 0 end end)) % 10 = 0"
_SHOW_SQL = ", ".join(f"list_transform({k}, lambda x: '{k}:' || x.s || ':' || (x.s + length(x.m)))" for k in KINDS)
#: base_report in DuckDB's SQL.
BASE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id, {_places_sql(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')} as email, {_places_sql(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')} as ip,
 {_places_sql(r'[0-9]([\x20-]?[0-9])+')} as card, {_places_sql(r'\+[0-9][\x20().0-9-]+[0-9]')} as phone from d),
g as (select doc_id, email, list_filter(ip, lambda x: list_max(list_transform(string_split(x.m, '.'), lambda p: case when length(ltrim(p, '0')) > 3 then 999 else cast('0' || ltrim(p, '0') as int) end)) <= 255) as ip,
 list_filter(card, lambda x: length({_TEN}) between 13 and 19 and {_LUHN_SQL}) as card, list_filter(phone, lambda x: length({_TEN}) between 9 and 15) as phone from f)
select doc_id, len(email) as n_email, len(ip) as n_ip, len(card) as n_card, len(phone) as n_phone, sha256(array_to_string(flatten([{_SHOW_SQL}]), ',')) as base_sha256 from g
"""
