"""Text views and text tests as column expressions.

Java's ``\\w``, ``\\s``, ``\\b`` and ``(?i)`` are ASCII by default. All patterns here go through
``unicode_regex`` so that accented words, no-break spaces and the like count as they should.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{1C}-\x{1F}]"
NOT_SPACE = r"[^\s\x{1C}-\x{1F}]"
_BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
_LETTERS = r"\(\?:[A-Za-z|]+\)"
_ESCAPES = ((r"\b", _BOUNDARY), (r"\w", WORD), (r"\s", SPACE), (r"\S", NOT_SPACE), (r"\d", r"\p{Nd}"))


def unicode_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern in which ``\\b \\w \\s \\S \\d`` have their Unicode meaning and ``.`` excludes only a line feed.

    A boundary before or after plain letters needs to look at one side only, which is twice as fast.
    """
    pattern = re.sub(rf"\\b(?={_LETTERS}|[A-Za-z])", lambda _: f"(?<!{WORD})", pattern)
    pattern = re.sub(rf"({_LETTERS}|(?<!\\)[A-Za-z])\\b", lambda found: f"{found[1]}(?!{WORD})", pattern)
    for escape, explicit in _ESCAPES:
        pattern = pattern.replace(escape, explicit)
    return ("(?iudU)" if ignore_case else "(?dU)") + pattern


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for all. A boundary before a letter that all start with is tested once per place, not once each."""
    if all(re.match(rf"\\b(?:{_LETTERS}|[A-Za-z])", pattern) for pattern in patterns):
        return rf"(?<!\w)(?=[A-Za-z])(?:{'|'.join(pattern[2:] for pattern in patterns)})"
    return "|".join(f"(?:{pattern})" for pattern in patterns)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def strip(text: Column) -> Column:
    """Drops white space of every kind at both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+\\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only texts. Looks no further than the first visible character."""
    return ~F.coalesce(text.rlike(f"(?U){NOT_SPACE}"), F.lit(False))


def mask_text(text: Column) -> Column:
    """Handles become ``@user``, then links become ``http``. E-mail addresses keep their form.

    A plain search first: only texts that may hold a handle or a link see a regular expression.
    """
    def links(masked: Column) -> Column:
        found = F.contains(masked, F.lit("://")) | F.contains(F.lower(masked), F.lit("www."))
        return F.when(found, F.regexp_replace(masked, unicode_regex(fixed.LINK_PATTERN, ignore_case=True), "http")).otherwise(masked)

    handles = F.regexp_replace(text, unicode_regex(fixed.HANDLE_PATTERN), "@user")
    return bind(F.when(F.contains(text, F.lit("@")), handles).otherwise(text), links)


def light_clean(text: Column) -> Column:
    """The view for sentiment scorers: masked, three entities decoded, white space collapsed."""
    decoded = mask_text(text)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    # a single plain space stays as it is and needs no replacement
    return F.trim(F.regexp_replace(decoded, f"(?U){SPACE}{{2,}}|[{SPACE}&&[^ ]]", " "))


def topic_tokens(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """The view for topic models: lower-case content words of three characters or more, as an array."""
    words = F.regexp_extract_all(F.lower(light_clean(text)), F.lit(f"({fixed.TOPIC_TOKEN_PATTERN})"), 1)
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def dedupe_key(text: Column) -> Column:
    """Lower case, every run of non-word characters one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def is_english(text: Column, min_hits: int = 1, hints: Sequence[str] = fixed.ENGLISH_HINTS) -> Column:
    """At least 80 % of the letters are ASCII and at least ``min_hits`` words are common English words."""
    hint = f"(?i)(?<![A-Za-z'])(?:{'|'.join(hints)})(?![A-Za-z'])"
    hits = text.rlike(hint) if min_hits == 1 else F.regexp_count(text, F.lit(hint)) >= min_hits
    # a of a + b letters is 80 % where a >= 4 b; texts of one byte per character have no other letters
    ascii_letters = F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))
    other_letters = F.regexp_count(text, F.lit(r"[\p{L}&&[^A-Za-z]]"))
    mostly_ascii = (F.length(text) == F.octet_length(text)) | (ascii_letters >= 4 * other_letters)
    some = text.rlike("[A-Za-z]") if min_hits < 1 else F.lit(True)
    return F.coalesce(hits & some & mostly_ascii, F.lit(False))


def is_spam(text: Column, patterns: Sequence[str] = fixed.SPAM_PATTERNS) -> Column:
    """A spam pattern, six hashtags or three links."""
    any_pattern = unicode_regex(any_of(patterns), ignore_case=True)
    many = (count_of(text, "#") >= fixed.SPAM_HASHTAGS) | (count_of(F.lower(text), "http") >= fixed.SPAM_LINKS)
    return F.coalesce(many | text.rlike(any_pattern), F.lit(False))


def confounders(text: Column) -> dict[str, Column]:
    """Text features whose balance between the periods is worth a check."""
    return {
        "length_words": F.regexp_count(text, F.lit(f"(?U){NOT_SPACE}+")).cast("bigint"),
        "has_link": F.contains(text, F.lit("http")).cast("int"),
        "has_mention": F.contains(text, F.lit("@user")).cast("int"),
        "hashtags": count_of(text, "#"),
    }
