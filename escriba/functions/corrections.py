"""Correction of recognised Spanish legal text: tokens, ordered rewrites, clean-up. Tasks search their texts a batch at a time."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE, SPACES, WORD, arrow, re2, sql_literal, sql_strip

# Words as recognition may give them, and as they should be. Any casing counts; a right word in another casing is written anew, too.
TOKENS = {
    "FISCALIA": "FISCALÍA", "FlSCALÍA": "FISCALÍA",
    "MlNlSTERlO": "MINISTERIO",
    "PUBLICO": "PÚBLICO", "PÚBLlCO": "PÚBLICO",
    "INVESTIGACION": "INVESTIGACIÓN",
    "PROVlDENCIA": "PROVIDENCIA",
    "CARFETA": "CARPETA",
    "EXPEDlENTE": "EXPEDIENTE",
    "RESOLUCION": "RESOLUCIÓN",
    "DlSTRlTO": "DISTRITO",
    "AREQUlPA": "AREQUIPA",
    "CHlVAY": "CHIVAY",
    "PENAЛ": "PENAL",
    "ClVlL": "CIVIL",
    "CORPORATlVA": "CORPORATIVA",
    "DELlTO": "DELITO",
    "CÖNTRA": "CONTRA",
    "PATRlMONlO": "PATRIMONIO",
    "USURPACION": "USURPACIÓN",
    "APROPIACION": "APROPIACIÓN",
    "CODIGO": "CÓDIGO",
    "ARTICULO": "ARTÍCULO",
    "TITULO": "TÍTULO",
    "PROCEDlMlENTO": "PROCEDIMIENTO",
}

# Rewrites in the order in which they are applied; \1, \2, \3 are groups.
REWRITES = {
    "R1": (r"CARPETA\s+FISCAL[:\s]*(\d{10}-\d{4}-\d{1,3}-\d{1,2})", r"CARPETA FISCAL: \1"),
    "R2": (r"CARPETA\s+FlSCAL[:\s]*(\d{10}-\d{4}-\d{1,3}-\d{1,2})", r"CARPETA FISCAL: \1"),
    "R3": (r"EXP(?:EDIENTE)?\.?\s*N[°º]?\s*(\d{4,5}-\d{4}-\d{1,3}-\w{2,4}-\w{2})", r"EXPEDIENTE N° \1"),
    "R4": (r"EXP(?:EDlENTE)?\.?\s*N[°º]?\s*(\d{4,5}-\d{4}-\d{1,3}-\w{2,4}-\w{2})", r"EXPEDIENTE N° \1"),
    "R5": (r"RESOLUCIÓN\s*N[°º]?\s*(\d+[-\s]?\d*)", r"RESOLUCIÓN N° \1"),
    "R6": (r"RESOLUCION\s*N[°º]?\s*(\d+[-\s]?\d*)", r"RESOLUCIÓN N° \1"),
    "R7": (r"FISCALÍA\s+PROVINCIAL\s+(PENAL|CIVIL|FAMILIA)", r"FISCALÍA PROVINCIAL \1"),
    "R8": (r"FlSCALÍA\s+PROVlNClAL\s+(PENAL|ClVlL|FAMlLlA)", r"FISCALÍA PROVINCIAL \1"),
    "R9": (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"\1/\2/\3"),
    "R10": (r"(\d{1,2})\s+de\s+(\w+)\s+del?\s+(\d{4})", r"\1 de \2 del \3"),
    "R11": (r"\b([A-Z]{3})[-\s]?(\d{3})\b", r"\1-\2"),
    "R12": (r"\b([A-Z]{2})[-\s]?(\d{4})\b", r"\1-\2"),
    "R13": (r"Art\.?\s*(\d+)[°º]?", r"Artículo \1°"),
    "R14": (r"Inc\.?\s*(\d+)", r"Inciso \1"),
    "R15": (r"\s{2,}", " "),
    "R16": (r"\n{3,}", "\n\n"),
    "N1": (r"[\r\n]+", "\n"),
    "N2": (r"[ \t]+", " "),
    "N3": (r"\n\s*\n\s*\n+", "\n\n"),
}

_LOOKUP = {right.lower(): right for right in TOKENS.values()} | {wrong.lower(): right for wrong, right in TOKENS.items()}
#: For the SQL only.
_PIECES = f"([{WORD}]+|[^{WORD}]+)"


def _any(word: str) -> str:
    """A word in any casing, as a look-up of it in lower case finds it."""
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


def _any_but(word: str) -> str:
    """A word in any casing but as it is written."""
    return f"(?:{word[0].swapcase()}{_any(word[1:])}" + (f"|{word[0]}{_any_but(word[1:])}" if word[1:] else "") + ")"


def _wrong(right: str) -> str:
    """What becomes the right form."""
    return "|".join([_any_but(right), *(_any(w) for w, to in TOKENS.items() if to == right and w.lower() != right.lower())])


_TOKENS = {right: _wrong(right) for right in dict.fromkeys(TOKENS.values())}
#: R11 and R12 without what they leave as it is.
_PLATES = {"R11": r"([A-Z]{3})\s?(\d{3})", "R12": r"([A-Z]{2})\s?(\d{4})"}


def _replaced_words(texts: pa.Array, form: str, to: str) -> pa.Array:
    """form between word edges (no word character, or an end) replaced; to has \\1 and the edge's number for what stands there.

    RE2 doesn't look around, so edges are part of a match, and of two matches with one character between them only the first is found in a round. The other is found
    in the next, as nothing that was replaced matches again."""
    for _ in range(2):
        if not pc.any(pc.match_substring_regex(texts, form)).as_py():
            break
        texts = pc.replace_substring_regex(texts, f"(^|[^{WORD}])(?:{form})([^{WORD}]|$)", to)
    return texts


def _with_tokens(texts: pa.Array) -> pa.Array:
    for right, wrong in _TOKENS.items():
        texts = _replaced_words(texts, wrong, rf"\1{right}\2")
    return texts


def _rewritten(texts: pa.Array, names: tuple[str, ...]) -> pa.Array:
    for name in names:
        if name in _PLATES:
            texts = _replaced_words(texts, arrow(_PLATES[name]), r"\1\2-\3\4")
        else:
            pattern, to = REWRITES[name]
            texts = pc.replace_substring_regex(texts, arrow(pattern), to)
    return texts


#: Behind R15 no two white spaces stand together, so R16 and N3 find nothing, and N1 and N2 change single characters.
_CORRECTIONS = tuple(name for name in REWRITES if name not in ("R16", "N1", "N2", "N3"))


def _corrected(texts: pa.Array) -> pa.Array:
    single = _rewritten(_with_tokens(texts), _CORRECTIONS)
    return pc.utf8_trim(pc.replace_substring(pc.replace_substring(single, "\r", "\n"), "\t", " "), SPACES)


def correct_tokens(c: Column) -> Column:
    """Every whole word of TOKENS, right or wrong, in its right form.

    A listed word is a maximal run of word characters and its right form maps to itself, so what becomes one right form is replaced at a time, in any order."""
    return F.arrow_udf(_with_tokens, "string")(c)


def rewrite(c: Column, *names: str) -> Column:
    """The named rewrites in their order (all of them, if none is named)."""
    return F.arrow_udf(lambda texts: _rewritten(texts, names or tuple(REWRITES)), "string")(c)


def correct(c: Column) -> Column:
    """Tokens, rewrites, clean-up, strip."""
    return F.arrow_udf(_corrected, "string")(c)


# --- the same in DuckDB's SQL, for oracles


def sql_tokens(x: str) -> str:
    table = "map {" + ", ".join(f"{sql_literal(k)}: {sql_literal(v)}" for k, v in _LOOKUP.items()) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{_PIECES}', 1), lambda w: coalesce({table}[lower(w)], w)), '')"


def sql_rewrite(x: str, *names: str) -> str:
    for name in names or REWRITES:
        pattern, to = REWRITES[name]
        if pattern.startswith(r"\b"):
            # no word edges: the neighbours are taken along, and a second round finds what shared one
            body = re2(pattern[2:-2])[4:]
            shift = re.sub(r"\\(\d)", lambda m: "\\" + str(int(m[1]) + 1), to)
            for _ in range(2):
                x = f"regexp_replace({x}, {sql_literal(f'(?i)(^|[^{WORD}]){body}([^{WORD}]|$)')}, {sql_literal(chr(92) + '1' + shift + chr(92) + '4')}, 'g')"
        else:
            x = f"regexp_replace({x}, {sql_literal(re2(pattern))}, {sql_literal(to)}, 'g')"
    return x


def sql_correct(x: str) -> str:
    return sql_strip(sql_rewrite(sql_tokens(x)))


__all__ = ["REWRITES", "SPACE", "TOKENS", "correct", "correct_tokens", "rewrite", "sql_correct", "sql_rewrite", "sql_tokens"]
