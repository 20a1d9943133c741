"""Native column functions for clause text.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match the reference behaviour exactly)
# The characters Python's ``str.split()`` / ``str.strip()`` treat as
# whitespace: \t \n \x0b \x0c \r, \x1c-\x1f, space, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# As an explicit class (RE2 / DuckDB oracle):
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same set for Java regex: Unicode White_Space plus \x1c-\x1f (about 3x
# faster than the explicit list); patterns using it start with (?U).
JAVA_WS = r"[\s\x{1C}-\x{1F}]"
# A clause type is the text inside the first pair of double quotes.
QUOTED_TYPE = r'"([^"]+)"'
UNKNOWN_TYPE = "Unknown"
# Contract file names lose a trailing ".pdf" (any case, trailing blanks).
PDF_SUFFIX = r"(?iU)\.pdf" + JAVA_WS + "*$"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """``s.split()``: whitespace-separated tokens as ``array<string>``
    (``[]`` for empty or whitespace-only text, null for null).  One regex
    split plus an empty-token filter: the text is scanned once."""
    return F.filter(F.split(_c(c), "(?U)" + JAVA_WS + "+"), lambda x: x != "")


def normalize_ws(c) -> Column:
    """``' '.join(s.split())``: collapse every Unicode whitespace run into one
    space and drop leading/trailing whitespace."""
    return F.array_join(words(c), " ")


def unicode_trim(c) -> Column:
    """``s.strip()`` with Python's whitespace definition (``F.trim`` strips
    only U+0020)."""
    return F.regexp_replace(_c(c), "(?U)^" + JAVA_WS + "+|" + JAVA_WS + "+$", "")


def word_count(c) -> Column:
    """``len(s.split())``; 0 for empty or whitespace-only text and for null."""
    w = words(c)
    # explicit null branch: size(null) is -1 when the legacy flag is on
    return F.when(w.isNull(), F.lit(0)).otherwise(F.size(w)).cast("int")


def clause_type_from_question(c) -> Column:
    """Text inside the first pair of double quotes (>= 1 char, may span
    lines), else ``'Unknown'``."""
    found = F.regexp_extract(_c(c), QUOTED_TYPE, 1)
    return F.when(found.isNull() | (found == ""), F.lit(UNKNOWN_TYPE)).otherwise(found)


def canonical_contract_name(c) -> Column:
    """Strip a trailing ``.pdf`` (any case, trailing blanks), then trim."""
    return unicode_trim(F.regexp_replace(_c(c), PDF_SUFFIX, ""))


def contains_ci(c, needle: str) -> Column:
    """Null-safe case-insensitive ``contains``: null text counts as no match
    (pandas would give NaN and misfilter)."""
    return F.coalesce(F.lower(_c(c)).contains(needle.lower()), F.lit(False))


def clean_clause_text(c) -> Column:
    """Normalised and lower-cased clause text (the cleaned clause column)."""
    return F.lower(normalize_ws(c))
