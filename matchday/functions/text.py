"""String functions found in the scraper and the UI (SC1-SC10, SC22), as built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import _col


def strip_suffix(c, suffix) -> Column:
    """Drop a given superscript glued to a value's end, `0.54-0.12` and `-0.12` -> `0.54`, then trim (SC6).
    A value that doesn't end in it, or an empty or null superscript, leaves the value."""
    value, sup = _col(c), F.coalesce(_col(suffix), F.lit(""))
    cut = F.substring(value, F.lit(1), F.char_length(value) - F.char_length(sup))
    return F.trim(F.when((sup != "") & value.endswith(sup), cut).otherwise(value))


def drop_newlines(c) -> Column:
    """Remove line breaks inside a cell (SC7)."""
    return F.regexp_replace(_col(c), r"[\r\n]", "")


def file_key(c) -> Column:
    """`Ayden Heaven` -> `ayden_heaven` (SC2 + SC8, ING8)."""
    return F.lower(F.regexp_replace(F.trim(_col(c)), " ", "_"))


def slug_to_name(slug: str) -> str:
    """URL slug -> lookup text: lower case, `-` -> space (FLT8). A Python string, not a column."""
    return slug.lower().replace("-", " ")


def name_lookup_key(c) -> Column:
    """Name side of a slug lookup: lower case, `-` and `#` -> space."""
    return F.lower(F.regexp_replace(_col(c), "[-#]", " "))


def code3(c) -> Column:
    """Three-letter upper-case code (`Arsenal` -> `ARS`) (SC9)."""
    return F.upper(F.substring(_col(c), 1, 3))


def initials(c) -> Column:
    """First letters of the first two words, upper case (SC9)."""
    parts = F.split(F.trim(_col(c)), r"\s+")
    return F.upper(F.concat_ws("", F.substring(F.get(parts, 0), 1, 1),
                              F.substring(F.get(parts, 1), 1, 1)))


def first_part(c, sep: str = ",") -> Column:
    """`Apr 11, 2026` -> `Apr 11` (SC10)."""
    return F.get(F.split(_col(c), sep), 0)


def contains_either(a, b) -> Column:
    """`a in b or b in a` (SC22)."""
    a, b = _col(a), _col(b)
    return (F.instr(b, a) > 0) | (F.instr(a, b) > 0)


def image_url_large(c) -> Column:
    """Thumbnail URL to the large variant (`40x40` -> `250x250`) (SC8)."""
    return F.replace(_col(c), F.lit("40x40"), F.lit("250x250"))
