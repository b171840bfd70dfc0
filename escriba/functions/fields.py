"""Named fields of legal documents: for each field the first pattern with a non-empty value wins."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACES, re2, spelt, sql_collapse, sql_literal, sql_strip, tidy, value_of

# Patterns of each field, in the order in which they are tried. Group 1 is the value, or the whole match where there is no group.
PATTERNS = {
    "carpeta_fiscal": [
        r"CARPETA\s+FISCAL[:\s]*(\d{10}-\d{4}-\d{1,3}-\d{1,2})",
        r"CARPETA\s+FlSCAL[:\s]*(\d{10}-\d{4}-\d{1,3}-\d{1,2})",
    ],
    "expediente": [
        r"EXP(?:EDIENTE)?\.?\s*N[°º]?\s*[:\s]*(\d{4,5}-\d{4}-\d{1,3}-\w{2,4}-\w{2})",
        r"EXP(?:EDlENTE)?\.?\s*N[°º]?\s*[:\s]*(\d{4,5}-\d{4}-\d{1,3}-\w{2,4}-\w{2})",
    ],
    "fiscalia": [
        r"FISCALÍA\s+(PROVINCIAL|SUPERIOR|SUPREMA)\s+(.+?)(?:DISTRITO|$)",
        r"FlSCALÍA\s+(PROVlNClAL|SUPERlOR|SUPREMA)\s+(.+?)(?:DlSTRlTO|$)",
    ],
    "distrito_fiscal": [
        r"DISTRITO\s+FISCAL\s+DE\s+([A-ZÁÉÍÓÚÑ\s]+)",
        r"DlSTRlTO\s+FlSCAL\s+DE\s+([A-ZÁÉÍÓÚÑ\s]+)",
    ],
    "delito": [
        r"DELITO[:\s]+(.+?)(?:\n|$)",
        r"DELlTO[:\s]+(.+?)(?:\n|$)",
        r"CONTRA\s+EL\s+(PATRIMONIO|HONOR|VIDA)",
        r"USURPACIÓN",
        r"APROPIACIÓN\s+ILÍCITA",
    ],
    "imputado": [
        r"IMPUTADO[:\s]+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|DELITO|AGRAVIADO)",
        r"lMPUTADO[:\s]+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|DELlTO|AGRAVlADO)",
        r"INVESTIGADO[:\s]+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|DELITO|AGRAVIADO)",
    ],
    "agraviado": [
        r"AGRAVIADO[:\s]+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|DELITO|IMPUTADO)",
        r"AGRAVlADO[:\s]+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|DELlTO|lMPUTADO)",
    ],
    "fecha": [
        r"(\d{1,2})\s+de\s+(\w+)\s+del?\s+(\d{4})",
        r"FECHA[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
        r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})",
    ],
    "resolucion": [
        r"RESOLUCIÓN\s*N[°º]?\s*(\d+[-\s]?\d*)",
        r"RESOLUCION\s*N[°º]?\s*(\d+[-\s]?\d*)",
    ],
    "juzgado": [
        r"JUZGADO\s+([A-ZÁÉÍÓÚÑ\s]+?)(?:DE|$)",
        r"JUZGADO\s+PENAL\s+([A-ZÁÉÍÓÚÑ\s\d]+)",
    ],
    "juez": [
        r"JUE[ZS][:\s]+([A-ZÁÉÍÓÚÑ\s]+?)(?:\n|$)",
        r"MAGISTRADO[:\s]+([A-ZÁÉÍÓÚÑ\s]+?)(?:\n|$)",
    ],
    "fiscal": [
        r"FISCAL[:\s]+([A-ZÁÉÍÓÚÑ\s]+?)(?:\n|$)",
        r"FlSCAL[:\s]+([A-ZÁÉÍÓÚÑ\s]+?)(?:\n|$)",
    ],
}


def _group(pattern: str) -> int:
    return int("(" in pattern.replace("(?:", ""))


def _clean(values: pa.Array) -> pa.Array:
    """The values without white space around them or runs of it inside, and without | and # at their ends; null if that leaves nothing."""
    left = pc.utf8_trim(pc.utf8_rtrim(tidy(values), "|#"), SPACES)
    return pc.if_else(pc.equal(left, ""), pa.scalar(None, left.type), left)


def _found(texts: pa.Array, field: str) -> pa.Array:
    """A failed match and a value that cleaning empties both lead to the next pattern."""
    found = pa.nulls(len(texts), texts.type)
    for p in PATTERNS[field]:
        if found.null_count:
            found = pc.coalesce(found, _clean(pc.struct_field(pc.extract_regex(texts, value_of(p)), "v")))
    return found


def extract(c: Column, field: str) -> Column:
    """The field's value in the text, or null."""
    return F.arrow_udf(lambda texts: _found(texts, field), "string")(c)


def long_date(c: Column) -> Column:
    """An extension (no field of its own in extract_map): the first date in words, as day, month in lower case, and year."""
    p = spelt(PATTERNS["fecha"][0])
    return F.when(c.rlike(p), F.concat(F.regexp_extract(c, p, 1), F.lit(" de "), F.lower(F.regexp_extract(c, p, 2)), F.lit(" del "), F.regexp_extract(c, p, 3)))


def extract_columns(c: Column) -> list[Column]:
    """All fields as columns, found by one function, so that the text (itself made by one, as a rule) is made and handed over once."""

    def every(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_found(texts, field) for field in PATTERNS], list(PATTERNS))

    found = F.arrow_udf(every, ", ".join(f"{field} string" for field in PATTERNS))(c)
    return [found[field].alias(field) for field in PATTERNS]


def as_map(fields: list[Column] | None = None) -> Column:
    """Only the fields that were found, in the order of PATTERNS. fields: the field columns (by name, if not given)."""
    pairs = [x for i, name in enumerate(PATTERNS) for x in (F.lit(name), fields[i] if fields else F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def sql_extract(x: str, field: str) -> str:
    """The same in DuckDB's SQL, for oracles."""
    found = []
    for p in PATTERNS[field]:
        v = sql_collapse(sql_strip(f"regexp_extract({x}, {sql_literal(re2(p))}, {_group(p)})"))
        found.append("nullif(" + sql_strip(f"regexp_replace({v}, '[|#]+$', '')") + ", '')")
    return f"coalesce({', '.join(found)})"
