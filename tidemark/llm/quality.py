"""Quality rules: one threshold table, compiled into one Spark projection.

Every measure is a Catalyst expression over the whole text, so the operator is a scan with projections: no exchange,
no user function, and the state of a task is one row. A rule names a measure and the closed range that it must lie
in; ``compile_rules`` turns a table of them into one column, the names of the rules that a text breaks.

Defined results: a null or empty text has no words, all its measures are 0 and it fails ``n_words``; a null
``doc_id`` is kept as it is; repeated rows give repeated rows; an empty table gives an empty table; columns of the
input that carry the name of a measure are replaced by the measure, others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import Columns

#: fixed values: white space, symbols, stop words of the four languages
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "nicht", "ein", "eine", "zu", "auf", "für", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "qui", "en", "du", "est", "pour", "dans", "par",
    "el", "los", "las", "y", "una", "del", "por", "con", "para", "no", "se", "es", "su",
)


class Rule(NamedTuple):
    """``measure`` must lie in [low, high]; an end that is None is open."""

    name: str
    measure: str
    low: float | None
    high: float | None


#: the base rules decide ``base_failed``; the others decide only ``kept``
BASE_RULES = (
    Rule("n_words", "n_words", 50, None),
    Rule("repeat_words", "repeat_word_percent", None, 50),
)
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("lines", "dup_line_ratio", None, 0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without white space. A null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _covered(positions: Column) -> Column:
    """Words under windows of three that begin at the sorted positions."""
    gaps = F.transform(positions, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of three words."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def repeated_words(hashes: Column, ordered: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more, the first copy included.

    ``ordered`` are the sorted hashes; equal neighbours are the repeated ones. A text with few of them looks each
    window up among them, any other sorts its windows by (hash, position): n log n for every text.
    """

    def by_look_up(found: Column) -> Column:
        return _covered_by(F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull()))

    def by_order() -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(placed, lambda s: F.transform(
            F.filter(s, lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False))
                     | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))),
            lambda e: e["i"]))
        return _covered_by(F.sort_array(found))

    repeated = F.array_distinct(F.filter(ordered, lambda h, j: F.coalesce(h == F.get(ordered, j + 1), F.lit(False))))
    return let(repeated, lambda d: F.when(F.size(d) == 0, F.lit(0))
               .when(F.size(d) <= 16, by_look_up(d)).otherwise(by_order()))


def _covered_by(positions: Column) -> Column:
    return let(positions, _covered)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and all measures."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars",
             "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "repeat_word_percent")
    given = Columns(docs)
    whole = F.coalesce(given[text], F.lit(""))
    staged = given.frame.select(
        *given.neutral(), whole.alias("__text"), words_of(given[text]).alias("__words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE)).alias("__lines"))
    hashed = staged.select("*", window_hashes(F.col("__words")).alias("__windows"))
    ordered = hashed.select("*", F.sort_array("__windows").alias("__ordered"))
    # a generator of one row: filters on the measures stay above it, so no measure is computed twice
    counted = ordered.select(*given.neutral(), F.inline(F.array(F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        repeated_words(F.col("__windows"), F.col("__ordered")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("__n_stop")))))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        *given.back(names), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("__n_stop") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.lit(100) * F.col("n_repeat_words") / n).alias("repeat_word_percent"))


def compile_rules(rules: Sequence[Rule]) -> Column:
    """The names of the broken rules, as one column."""

    def broken(rule: Rule) -> Column:
        value = F.col(rule.measure)
        below = value < rule.low if rule.low is not None else F.lit(False)
        above = value > rule.high if rule.high is not None else F.lit(False)
        return F.when(below | above, F.lit(rule.name))

    return F.array_compact(F.array(*(broken(rule) for rule in rules)))


def apply_rules(docs: DataFrame, text: str = "text", base: Sequence[Rule] = BASE_RULES,
                rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``broken`` (rule names) and ``kept``."""
    return measured(docs.drop("base_failed", "broken", "kept"), text).withColumns({
        "base_failed": F.size(compile_rules(base)) > 0,
        "broken": compile_rules([*base, *rules]),
    }).withColumn("kept", F.size("broken") == 0)
