"""Checks the word-bounded patterns, and the substring baseline beside them, against labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.patterns import Categories, pattern_flag, substring_flag
from ..operators.tables import evaluate_flags


def validate_patterns(checked: DataFrame, categories: Categories = fixed.PATTERN_CATEGORIES) -> DataFrame:
    """One row per flag: ``patterns`` and ``substring_baseline``."""
    text = F.col("text")
    return evaluate_flags(
        checked, {"patterns": pattern_flag(text, categories), "substring_baseline": substring_flag(text)})
