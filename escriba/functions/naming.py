"""File names, sizes and request options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff", "bmp"]
LANGUAGES = ["spa", "eng", "spa+eng"]
DEFAULT_LANGUAGE = "spa"
FORMATS = ["json", "md"]
MAX_BYTES = 100 * 1024 * 1024

# Answers to requests that are refused.
NO_PART = "No se proporcionó archivo"
NO_NAME = "No se seleccionó archivo"
BAD_FORMAT = "Formato no permitido. Use: " + ", ".join(EXTENSIONS)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; null without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def allowed(name: Column) -> Column:
    return F.coalesce(extension(name).isin(EXTENSIONS), F.lit(False))


def is_pdf(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def safe_name(name: Column) -> Column:
    """Folders become part of the name, accents go, white space becomes _, other characters go, dots and _ at the ends go."""
    plain = F.regexp_replace(F.translate(name, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"), r"[^\x00-\x7F]", "")
    joined = F.array_join(F.filter(F.split(F.translate(plain, "/\\", "  "), r"\s+"), lambda w: w != ""), "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+\z", "")


def stem(name: Column) -> Column:
    """The name without its last extension; dots that lead the name are part of it."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def size_mb(length: Column) -> Column:
    return length / F.lit(1024 * 1024)


def one_decimal(x: Column) -> Column:
    """A size to one decimal, of its exact value: halves to the even digit (format_string() would take them up)."""
    whole = F.floor(x)
    tenths = whole * 10 + F.rint((x - whole) * 10).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def language(value: Column) -> Column:
    """One of LANGUAGES, or else the default."""
    return F.when(value.isin(LANGUAGES), value).otherwise(F.lit(DEFAULT_LANGUAGE))


def is_set(value: Column, default: str) -> Column:
    """Options are set by "1"."""
    return F.coalesce(value, F.lit(default)) == "1"


def request_error(has_part: Column, name: Column, length: Column) -> Column:
    """Why a request is refused; null for a good one. Checks come in order: part, name, format, size."""
    return (
        F.when(~has_part, F.lit(NO_PART))
        .when(F.coalesce(name, F.lit("")) == "", F.lit(NO_NAME))
        .when(~allowed(name), F.lit(BAD_FORMAT))
        .when(length > MAX_BYTES, F.concat(F.lit("Archivo muy grande: "), one_decimal(size_mb(length)), F.lit("MB")))
    )


def request_status(length: Column, error: Column) -> Column:
    """The status of a refused request: 413 where only the size is wrong, else 400."""
    return F.when(error.startswith("Archivo muy grande") & (length > MAX_BYTES), 413).otherwise(400)


def label(field: Column) -> Column:
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))
