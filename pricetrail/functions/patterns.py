"""Small helpers around regular expressions and word lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    Rules mention their input many times; bound to a lambda variable the input's
    expression stands in the plan once, which keeps nested rules small.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rx(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match (or its group); NULL where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def rx_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def has_any(text: Column, needles: Iterable[str]) -> Column:
    """True when the text contains one of the words; one pattern, one scan."""
    return F.coalesce(text.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table; NULL for other keys."""
    pairs = ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def literal_list(words: Iterable[str]) -> Column:
    return F.expr("array(" + ", ".join(_quoted(w) for w in words) + ")")


def among(text: Column, words: Iterable[str]) -> Column:
    """``isin`` for fixed word lists: the list is one literal of the plan."""
    return F.array_contains(literal_list(words), text)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column) -> Column:
    """Letters and digits of folded text; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(text, "[^a-z0-9]+", ""), F.lit(""))


def blob(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))
