"""Keyword rules: whole-word matches and lower-case substring matches."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import keyword_regex, unique


# Beyond this many keywords one regex pass costs less than the substring tests.
_GUARD_LIMIT = 64
# Letters that match an ASCII letter case-insensitively without
# being lower-cased to it.
_ODD_CASE = ("\u017f", "\u0131", "\u0130")


def _may_match(text: Column, low: Column | None, keywords: list[str]) -> Column | None:
    """Necessary condition for a keyword match by byte search, or None.

    ``low`` is the lower-cased text; a byte search is several times cheaper than a
    case-insensitive pattern and nearly every text fails it.
    """
    if low is None or len(keywords) > _GUARD_LIMIT or not all(k.isascii() for k in keywords):
        return None
    tests = [low.contains(k) for k in unique(k.lower() for k in keywords)]
    return reduce(operator.or_, tests + [text.contains(c) for c in _ODD_CASE])


def has_keyword(text: Column, keywords: Iterable[str], low: Column | None = None) -> Column:
    """Whole-word, case-insensitive match of any keyword."""
    words = unique(keywords)
    may, found = _may_match(text, low, words), text.rlike(keyword_regex(words))
    return found if may is None else may & found


def sorted_unique_matches(text: Column, keywords: Iterable[str]) -> Column:
    """Distinct matches (case kept), in code-point order."""
    found = F.regexp_extract_all(text, F.lit(keyword_regex(keywords)), F.lit(1))
    return F.sort_array(F.array_distinct(found))


def joined_matches(text: Column, keywords: Iterable[str], sep: str, low: Column | None = None) -> Column:
    """``sorted_unique_matches`` joined by ``sep``; NULL when there is none."""
    words = unique(keywords)
    may = _may_match(text, low, words)
    found = F.nullif(F.array_join(sorted_unique_matches(text, words), sep), F.lit(""))
    return found if may is None else F.when(may, found)


def first_substring(text: Column, keywords: Iterable[str]) -> Column:
    """First *listed* keyword contained in the lower-cased text, else NULL."""
    low = F.lower(text)
    words = unique(keywords)
    return F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in words], F.lit(None).cast("string"))


def joined_substrings(text: Column, words: Iterable[str], sep: str = ", ",
                      low: Column | None = None) -> Column:
    """All listed words contained in the lower-cased text, joined; NULL when none."""
    low = F.lower(text) if low is None else low
    found = F.concat_ws(sep, *[F.when(low.contains(w), F.lit(w)) for w in words])
    return F.nullif(found, F.lit(""))
