"""Line-first quality rules.

Every line is judged first: navigation (separators dealt among short items), boilerplate (notices of sites, a line that repeats an earlier line of
the document, or a run of few different words), shouting, and punctuation (none where a sentence should end, or used as noise). Failing lines are removed; a document that loses too much of its text is rejected. Base rules on the whole text come before the method's verdict.

Line rules (a line is what \\n separates; lines without words are dropped and count as no loss):
- duplicate: equal to an earlier line of the document;
- navigation: of its words, at least NAV_PERCENT in 100 are bare separators (| > » · / - *), and there are at least 4 words;
- symbols: characters of #*$%&|<> number at least a tenth of the characters in words;
- ending: at least LINE_WORDS words and no mark in _ENDS at its end;
- notice: fewer than NOTICE_WORDS words, and phrases of _NOTICES (lower-cased, whatever stands between their words) are a quarter of them at least, so that prose that happens to
  hold one stays;
- shouting: at least 8 words that hold a letter, all letters upper-case;
- repeats: at least 8 words of which fewer than a third are different.
A document is rejected if its failing lines hold more than LOSS_PERCENT in 100 of its word characters.

Defined results: null texts have no words; texts without words fail; repeated rows, and rows without a doc_id, are answered each for itself. An
empty table has no rows; other columns are neither read nor returned. A text's words are held in memory as it is judged, so a very
long text takes some ten times its bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, text

LEAST_WORDS = 50
LOSS_PERCENT = 50
NAV_PERCENT = 25

LINE_WORDS, NOTICE_WORDS, NOTICE_SHARE = 4, 30, 4

# Marks that end a sentence (closing quotes and brackets may follow), and phrases of sites' notices.
_ENDS = tuple(".!?:;…。！？।؟")
_NOTICES = (
    "accept all cookies", "all rights reserved", "cookie policy", "click here", "enable javascript", "forgot your password", "javascript is disabled", "log in", "lorem ipsum",
    "privacy policy", "read more", "share on facebook", "share on twitter", "sign in", "sign up", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
    "this site uses cookies", "use of cookies", "uses cookies", "we use cookies", "your cart",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "datenschutzerklärung", "jetzt anmelden", "mehr lesen", "nutzungsbedingungen", "weiterlesen",
    "accepter les cookies", "conditions générales", "lire la suite", "mentions légales", "politique de confidentialité", "se connecter", "tous droits réservés",
    "aceptar cookies", "iniciar sesión", "leer más", "política de privacidad", "términos de uso", "todos los derechos reservados",
)
_CLOSING = "\"'”’»)]}*_ \t\r"
_NOTICE = re.compile(r"\b(?:" + "|".join(p.replace(" ", r"\W+") for p in _NOTICES) + r")\b", re.IGNORECASE)

_PARTS = re.compile(r"\w+")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_BARE = frozenset("| > » · / - * • < :".split())


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_chars: int
    #: the text without the lines that failed
    cleaned: str


def line_fails(words: list[str], chars: int) -> bool:
    """Whether a line of these words (chars: characters in them) fails by itself."""
    n = len(words)
    if n >= 4 and 100 * sum(w in _BARE for w in words) >= NAV_PERCENT * n:
        return True
    if n >= LINE_WORDS and not words[-1].rstrip(_CLOSING).endswith(_ENDS):
        return True
    joined = "".join(words)
    if n < NOTICE_WORDS and NOTICE_SHARE * sum(len(_PARTS.findall(m[0])) for m in _NOTICE.finditer(" ".join(words))) >= n:
        return True
    if 10 * (len(joined) - len(joined.translate(_SYMBOLS))) >= chars:
        return True
    if n >= 8:
        if 3 * len(set(words)) < n:
            return True
        if joined.isupper() and sum(any(c.isalpha() for c in w) for w in words) >= 8:
            return True
    return False


def judge(value: str) -> Verdict:
    lines = value.split("\n")
    # no word holds \n, so the words of the lines are those of the text
    seen: set[str] = set()
    all_words: list[str] = []
    kept_lines: list[str] = []
    n_chars = duplicates = lost = 0
    for line in lines:
        words = _WORD.findall(line)
        if not words:
            kept_lines.append(line)
            continue
        chars = sum(map(len, words))
        n_chars += chars
        all_words += words
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or line_fails(words, chars):
            lost += chars
        else:
            kept_lines.append(line)
    n = len(all_words)
    repeats = 0
    if n >= 3:
        windows = list(zip(all_words, all_words[1:], all_words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = -1  # words before it are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 2 - max(covered, i - 1)
                    covered = i + 2
    symbols = len(value) - len(value.translate(_SYMBOLS))
    base = n < LEAST_WORDS or 100 * repeats > 50 * n
    good = not base and 100 * lost <= LOSS_PERCENT * n_chars
    return Verdict(n, n_chars, symbols, duplicates, repeats, base, good, lost, "\n".join(kept_lines))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def clean(docs: DataFrame) -> DataFrame:
    """The report's columns and text, without the lines that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                v = [judge(t) for t in part.column(1).to_pylist()]
                columns = {name: [getattr(x, name) for x in v] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")}
                yield pa.record_batch({"doc_id": part.column(0), **columns, "text": pa.array([x.cleaned for x in v], pa.string())})

    return frames.doc_texts(docs).mapInArrow(run, f"{SCHEMA}, text string")


def report(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, base_failed, kept and the word characters of failing lines."""
    return clean(docs).drop("text")


def base_report(docs: DataFrame) -> DataFrame:
    """Of the report, the counts on the whole text and what they decide."""
    return report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: base_report in DuckDB's SQL.
BASE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, j, array_to_string(w[j : j + 2], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 1)) as j from d where len(w) >= 3)),
m as (select doc_id, j from (select doc_id, j, count(*) over (partition by doc_id, win) as c from g) where c > 1),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(j, j + 3)) as p from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(w) < 50 or 100 * coalesce(r.n, 0) > 50 * len(w) as base_failed
from d left join l on d.doc_id = l.doc_id left join r on d.doc_id = r.doc_id
"""
