"""Sentiment labels and the lexicon score as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import bind, count_of

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def label_from_compound(compound: Column, threshold: float = fixed.LABEL_THRESHOLD) -> Column:
    """Both bounds are inclusive."""
    return (
        F.when(compound >= threshold, "positive").when(compound <= -threshold, "negative")
        .when(compound.isNotNull(), "neutral")
    )


def source_label(target: Column) -> Column:
    """Label of the labelled corpus; null for an unknown target."""
    label = F.lit(None).cast("string")
    for code, name in fixed.SOURCE_LABELS.items():
        label = F.when(target == code, name).otherwise(label)
    return label


def normalize_label(raw: str) -> str:
    """Label name of a model: a generic ``label_0/1/2``, else by its first three letters."""
    key = str(raw).strip().lower()
    by_prefix = {name[:3]: name for name in fixed.SENTIMENTS}
    label = fixed.MODEL_LABELS.get(key) or by_prefix.get(key[:3])
    if label is None:
        raise ValueError(f"no sentiment for the model label {raw!r}")
    return label


def negative_flag(sentiment: Column) -> Column:
    return (sentiment == "negative").cast("int")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def lexicon_compound(
    text: Column,
    valence: Mapping[str, float] = fixed.VALENCE,
    negators: Sequence[str] = fixed.NEGATORS,
    intensifiers: Sequence[str] = fixed.INTENSIFIERS,
) -> Column:
    """Rule-based score in [-1, 1].

    Lower-cased words and their positions are found once per text. Only texts with a lexicon word go
    through the weighting, and there only the positions of such words are visited.
    """
    names = list(valence)
    lowered = F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit("([a-z][a-z']*)"), 1)
    written = F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z']*)"), 1)
    points = F.create_map(*chain.from_iterable((F.lit(name), F.lit(float(valence[name]))) for name in names))
    bangs = F.least(count_of(text, "!"), F.lit(fixed.EXCLAMATION_MAX))

    def weigh(low: Column) -> Column:
        but_at = F.array_position(low, "but")
        hits = F.filter(F.sequence(F.lit(1), F.size(low)), lambda at: F.element_at(low, at).isin(*names))

        def total(words: Column) -> Column:
            some_lower = F.exists(words, lambda word: word == F.lower(word))

            def value(at: Column) -> Column:
                word = F.element_at(words, at)
                before = F.slice(low, F.greatest(at - fixed.NEGATION_REACH, F.lit(1)),
                                 F.least(at - 1, F.lit(fixed.NEGATION_REACH)))
                capitals = (F.length(word) > 1) & (word == F.upper(word)) & some_lower
                intense = (at > 1) & F.get(low, at - 2).isin(*intensifiers)
                negated = (at > 1) & F.arrays_overlap(before, _strings(negators))
                points_here = F.element_at(points, F.element_at(low, at))
                points_here = points_here * F.when(capitals, fixed.CAPITALS_FACTOR).otherwise(1.0)
                points_here = points_here * F.when(intense, fixed.INTENSIFIER_FACTOR).otherwise(1.0)
                points_here = points_here * F.when(negated, fixed.NEGATION_FACTOR).otherwise(1.0)
                side = F.when(but_at == 0, 1.0).when(at > but_at, fixed.AFTER_BUT_FACTOR)
                return points_here * side.otherwise(fixed.BEFORE_BUT_FACTOR)

            return F.aggregate(hits, F.lit(0.0), lambda total_so_far, at: total_so_far + value(at))

        return F.when(F.arrays_overlap(low, _strings(names)), bind(written, total)).otherwise(0.0)

    def squash(total: Column) -> Column:
        shouted = total + F.signum(total) * F.lit(fixed.EXCLAMATION_STEP) * bangs
        return bind(shouted, lambda s: s / F.sqrt(s * s + fixed.COMPOUND_NORM))

    return bind(bind(lowered, weigh), squash)
