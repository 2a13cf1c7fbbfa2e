"""Column -> Column text helpers (all JVM-side, no Python UDF).

The regular expressions are written so that they behave the same in Spark
(Java regex) and in DuckDB (RE2); the oracle SQL reuses them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomspark.fixed_values import NA_TOKENS

# Python's str.strip() removes every character for which str.isspace() holds
# (Unicode White_Space plus the separators U+001C..U+001F); Spark's one-argument
# trim() removes only U+0020.  The set is built from that rule and handed to
# trim(str, chars), which strips any of those code points from both ends.
WS_CHARS = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
# The same set as a regular-expression class (used by the SQL oracle).
WS_CLASS = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
STRIP_PATTERN = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
BOM_PATTERN = r"^\x{FEFF}"
# What a numeric coercion accepts: optional sign, digits with an optional
# fraction (or a bare fraction), optional exponent.  No "inf"/"nan"/"1d".
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """Unicode-aware strip of both ends (str.strip semantics), no regex."""
    return F.trim(c, F.lit(WS_CHARS))


def clean_cell(c: Column) -> Column:
    """null -> '' then strip: the normal form of every BOM text cell."""
    return strip(F.coalesce(c, F.lit("")))


def norm_cell(c: Column) -> Column:
    """clean_cell + lower-case: the form used to find header rows."""
    return F.lower(clean_cell(c))


def na_to_null(c: Column) -> Column:
    """Exact-match NA tokens become null (no trimming first)."""
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_count(c: Column) -> Column:
    """Numeric coercion of a stripped count cell, truncated toward zero.

    Non-numeric text, infinities and values outside bigint become null.
    """
    as_long = c.try_cast("bigint")
    via_double = c.try_cast("double").try_cast("bigint")
    return F.when(c.rlike(NUMBER_PATTERN), F.coalesce(as_long, via_double))


def money(c: Column) -> Column:
    """Whole dollars with thousands separators: 1234 -> '$1,234'."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def thousands(c: Column) -> Column:
    """Dollars as rounded thousands (half-even): 78000 -> '78k'."""
    return F.concat(
        F.regexp_replace(F.format_number(c.cast("double") / F.lit(1000.0), 0), ",", ""),
        F.lit("k"),
    )


def html_escape(c: Column) -> Column:
    """Escape & < > " ' (ampersand first)."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out
