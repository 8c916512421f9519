"""Text folding and search terms as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of the Latin blocks that decompose into a plain letter and marks, and
# the marks themselves, which go wherever they stand.
_LATIN = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
_BASE = {c: unicodedata.normalize("NFD", c)[0] for c in _LATIN if unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.decomposition(c)}
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED = "".join(_BASE)
PLAIN = "".join(_BASE.values())
MAX_TERMS = 8
MAX_QUERY_CHARS = 200
_PY_FOLD = str.maketrans(ACCENTED, PLAIN, MARKS)


def fold(text: Column) -> Column:
    """Lower case without accents and other marks; NULL becomes the empty string."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), ACCENTED + MARKS, PLAIN))


def fold_key(text: Column) -> Column:
    """``fold`` and trim; NULL stays NULL."""
    return F.trim(F.lower(F.translate(text, ACCENTED + MARKS, PLAIN)))


def search_terms(query: str | None) -> list[str]:
    """Distinct folded terms of a query, in order."""
    text = query or ""
    terms = list(dict.fromkeys(text.translate(_PY_FOLD).lower().split()))
    if len(text) > MAX_QUERY_CHARS or len(terms) > MAX_TERMS:
        raise ValueError("a search takes at most 8 terms and 200 characters")
    return terms


def matches_all_terms(query: str | None, fields: list[Column]) -> Column | None:
    """Every term occurs in some field; wildcards are plain text. None without terms."""
    condition = None
    for term in search_terms(query):
        hit = None
        for field in fields:
            found = fold(field).contains(F.lit(term))
            hit = found if hit is None else hit | found
        condition = hit if condition is None else condition & hit
    return condition


def alnum(text: Column) -> Column:
    return F.regexp_replace(fold_key(text), "[^a-z0-9]", "")


def words(text: Column) -> Column:
    """Folded text with everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(fold_key(text), "[^a-z0-9]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def ordered_terms(text: Column) -> Column:
    """Order-preserving distinct folded words of a text."""
    return F.array_distinct(F.filter(F.split(fold_key(text), r"\s+"), lambda w: w != ""))
