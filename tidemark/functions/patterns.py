"""Word-bounded pattern categories and the substring baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import WORD, unicode_regex

Categories = Mapping[str, Sequence[str]]


def choose_categories(names: Sequence[str] | None = None, known: Categories = fixed.PATTERN_CATEGORIES) -> dict:
    """The named categories in the given order (all by default)."""
    if not names:
        return dict(known)
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return {name: known[name] for name in names}


def category_regex(patterns: Sequence[str]) -> str:
    """One case-insensitive alternation between word boundaries. Patterns start and end with a word character."""
    return unicode_regex(f"(?<!{WORD})(?:{'|'.join(patterns)})(?!{WORD})", ignore_case=True)


def pattern_flag(text: Column, categories: Categories = fixed.PATTERN_CATEGORIES) -> Column:
    """True where any category matches: one scan over the text, up to the first hit."""
    return F.coalesce(text.rlike(category_regex([p for group in categories.values() for p in group])), F.lit(False))


def _details(text: Column, categories: Categories, extract: bool) -> Column:
    hits = [F.when(text.rlike(category_regex(patterns)), F.lit(name)) for name, patterns in categories.items()]
    names = F.array_compact(F.array(*hits)).alias("categories")
    if not extract:
        return names
    found = [F.regexp_extract_all(text, F.lit(category_regex(patterns)), 0) for patterns in categories.values()]
    terms = F.array_distinct(F.transform(F.concat(*found), F.lower)).alias("terms")
    return F.struct(F.lit(True).alias("flagged"), names, terms)


def matched_categories(text: Column, categories: Categories = fixed.PATTERN_CATEGORIES) -> Column:
    """Names of the matching categories, in their given order. Only flagged texts are scanned category by category."""
    nothing = F.array().cast("array<string>")
    return F.when(pattern_flag(text, categories), _details(text, categories, False)).otherwise(nothing)


def pattern_match(text: Column, categories: Categories = fixed.PATTERN_CATEGORIES) -> Column:
    """``struct<flagged, categories, terms>``; terms are lower-case, distinct, in order of category and place."""
    none = F.array().cast("array<string>")
    nothing = F.struct(F.lit(False).alias("flagged"), none.alias("categories"), none.alias("terms"))
    return F.when(pattern_flag(text, categories), _details(text, categories, True)).otherwise(nothing)


def substring_flag(text: Column, terms: Sequence[str] = fixed.BASELINE_TERMS) -> Column:
    """The baseline: any term anywhere in the text."""
    lowered = F.lower(text)
    flag = F.lit(False)
    for term in terms:
        flag = flag | F.contains(lowered, F.lit(term))
    return F.coalesce(flag, F.lit(False))
