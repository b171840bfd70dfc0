"""One notation of patterns, three dialects: Python's (what the rules mean), Java's (Spark) and RE2's (Arrow, and DuckDB in tests and oracles).

Patterns are written as Python understands them: \\w \\s \\d \\b are Unicode-aware and matching ignores case. Java's and RE2's
classes are ASCII by default, so they are written out. Where Spark's tasks apply them (spelt in Java, arrow in RE2), letters are, too, as classes of their
casings. Corrections and fields are some 70 patterns on every text; Arrow's kernels search a batch of texts for one by RE2's automaton, which takes
a fraction of what one of Java's takes for each character.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The insides of character classes.
WORD, SPACE, DIGIT = r"\p{L}\p{N}_", r"\t-\r\x1c-\x20\x85\p{Z}", r"\p{Nd}"
_INSIDE = {"w": WORD, "s": SPACE, "d": DIGIT}
#: The characters of SPACE, and the same class for Java: bits, then a range that most characters are outside of.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
JAVA_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&\p{Z}]"
_JAVA_INSIDE = _INSIDE | {"s": JAVA_SPACE}
#: What else Unicode's rules take for an ASCII letter in some casing, alone and in the range from A to Z.
_ODD, _ODD_RANGE = {"i": "ıİ", "s": "ſ", "k": "\u212a"}, "ıſ"
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def casings(c: str) -> str:
    """A letter in all its casings."""
    return "".join(sorted({c, c.lower(), c.upper()})) + _ODD.get(c.lower(), "")


def _written_out(pattern: str, edge: str | None, end: str | None, letters: bool = False, kinds: dict[str, str] = _INSIDE) -> str:
    """letters: case is written out, too."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            kind = pattern[i + 1]
            i += 2
            if kind in kinds:
                out.append(kinds[kind] if inside else f"[{kinds[kind]}]")
            elif kind == "b":
                if edge is None:
                    raise ValueError("RE2 has no Unicode word edge")
                out.append(edge)
            else:
                out.append("\\" + kind)
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        if letters and c.isalpha():
            if inside and pattern[i + 1] == "-" and pattern[i + 2] != "]":
                if pattern[i : i + 3] != "A-Z":
                    raise ValueError("only the range from A to Z")
                out.append(f"A-Za-z{_ODD_RANGE}")
                i += 3
                continue
            every = casings(c)
            out.append(every if inside or len(every) == 1 else f"[{every}]")
        else:
            out.append(end if c == "$" and not inside and end is not None else c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """For Spark: case ignored by Unicode rules; only a line feed ends a line; $ also stands before a final line feed."""
    return "(?iud)" + _written_out(pattern, _EDGE, None)


def spelt(pattern: str) -> str:
    """java(pattern) with the casings of letters written out, which matches the same in a fraction of the time."""
    return "(?d)" + _written_out(pattern, _EDGE, None, letters=True, kinds=_JAVA_INSIDE)


def arrow(pattern: str) -> str:
    """For Arrow's kernels: what spelt(pattern) matches, but that $ before a final line feed takes it along."""
    return _written_out(pattern, None, r"\n?$", letters=True).replace(r"\x85", r"\x{85}")


def value_of(pattern: str) -> str:
    """arrow(pattern) with a single group, named v: the first, or all where there is none."""
    head, *rest = re.split(r"\((?!\?)", pattern, maxsplit=1)
    if not rest:
        return f"(?P<v>{arrow(pattern)})"
    return arrow(head) + "(?P<v>" + arrow(re.sub(r"\((?!\?)", "(?:", rest[0]))


def re2(pattern: str) -> str:
    """For DuckDB. $ before a final line feed takes it along, which no captured group shows."""
    return "(?i)" + _written_out(pattern, None, r"\n?$").replace(r"\x85", r"\x{85}")


def strip(c: Column) -> Column:
    """Without white space at either end, as Python understands it (trim() knows spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, f"[{JAVA_SPACE}]+", " ")


def tidy(texts: pa.Array) -> pa.Array:
    """Without white space at either end, and every run of it as one space."""
    return pc.replace_substring_regex(pc.utf8_trim(texts, SPACES), arrow(r"\s+"), " ")


def sql_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    s = SPACE.replace(r"\x85", r"\x{85}")
    return f"regexp_replace({x}, '^[{s}]+|[{s}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE.replace(chr(92) + 'x85', chr(92) + 'x{85}')}]+', ' ', 'g')"
