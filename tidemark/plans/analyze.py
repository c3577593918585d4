"""Score posts, and compare the two periods."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.patterns import Categories, matched_categories, pattern_match
from ..functions.sentiment import negative_flag
from ..functions.text import confounders
from ..operators.bootstrap import standardized_difference, topic_prevalence
from ..operators.regression import study_regression
from ..operators.scorers import Scorer, error_counts, without_errors
from ..operators.tables import (
    chi_square, contingency, mean_differences, sentiment_shares, share_difference, truth_check)
from ..operators.topics import fit_topics
from ..sizes import settle
from ..storage import as_table

CELL = ("period", "topic", "moderation", "sentiment")
#: results that need the topic model
TOPIC_RESULTS = frozenset(("topics", "topic_prevalence", "negative_share_topic_adjusted", "regression_negative"))


def score(df: DataFrame, scorer: Scorer, categories: Categories = fixed.PATTERN_CATEGORIES) -> DataFrame:
    """Adds sentiment, compound, status, moderation, its categories and the scorer's name. No exchange.

    Works on batch and streaming frames alike: every column depends on its own row.
    """
    hits = F.array_join(matched_categories(F.col("text"), categories), ";")
    scored = scorer.score(df).withColumn("moderation_categories", F.coalesce(hits, F.lit("")))
    return scored.withColumns({
        "moderation": (F.col("moderation_categories") != "").cast("int"), "scorer": F.lit(scorer.name)})


def analyze(
    scored: DataFrame,
    n_topics: int = fixed.TOPICS,
    seed: int = fixed.SEED,
    n_boot: int = fixed.BOOTSTRAP_DRAWS,
    materialize: bool = True,
    only: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """One table per result; ``only`` names the wanted ones, and without those that need it no topic model is fitted.

    The scored posts are written once. After the topics are known everything that is a count comes from one
    table of cells (period, topic, moderation, sentiment).
    """
    if materialize:
        scored = as_table(scored, "scored")
    ok = without_errors(scored)
    wanted = (lambda name: True) if only is None else set(only).__contains__
    results: dict[str, DataFrame] = {}

    def add(name: str, make: Callable[[], DataFrame]) -> None:
        if wanted(name):
            results[name] = make()

    model = None
    if any(map(wanted, TOPIC_RESULTS)):
        model = fit_topics(ok, n_topics, seed, keep=["period", "moderation", "sentiment"])
        counted, cell = model.assign(), CELL
    else:
        counted, cell = ok, [name for name in CELL if name != "topic"]
    # a handful of cells: periods x topics x flag x labels
    cells = settle(counted.groupBy(*cell).agg(F.count("*").alias("n")), "cells").withColumn("negative", negative_flag(F.col("sentiment")))
    talk = cells.filter("moderation = 1")
    add("scorer", lambda: scored.agg(F.first("scorer").alias("scorer")))
    add("posts", lambda: cells.groupBy("period").agg(F.sum("n").alias("posts")))
    add("scorer_errors_excluded", lambda: error_counts(scored))
    add("sentiment_shares", lambda: sentiment_shares(cells, n="n"))
    add("sentiment_chi_square", lambda: chi_square(contingency(cells, "period", "sentiment", fixed.SENTIMENTS, n="n")))
    add("confounders_smd", lambda: mean_differences(ok, confounders(F.col("text"))))
    add("moderation_share", lambda: share_difference(cells, F.col("moderation"), n="n"))
    inside = ("moderation_sentiment_chi_square", "moderation_negative_share")
    if any(map(wanted, inside)) and talk.select("period").distinct().count() == 2:
        add(inside[0], lambda: chi_square(contingency(talk, "period", "sentiment", fixed.SENTIMENTS, n="n")))
        add(inside[1], lambda: share_difference(talk, F.col("negative"), n="n"))
    if model is not None:
        described = model.describe()
        add("topics", lambda: described)
        add("topic_prevalence", lambda: label_topics(topic_prevalence(cells, "topic", n_boot, seed, n="n"), described))
        add("negative_share_topic_adjusted", lambda: standardized_difference(cells, "negative", "topic", n_boot, seed, n="n"))
        add("regression_negative", lambda: study_regression(cells, n="n"))
    if "true_moderation" in scored.columns:
        add("check_against_truth", lambda: truth_check(ok))
    return results


def label_topics(prevalence: DataFrame, topics: DataFrame) -> DataFrame:
    """Prevalence with the label of each topic, ``(none)`` for posts without one. One row per topic on both sides."""
    labels = topics.select("topic", "label")
    return prevalence.join(labels, "topic", "left").withColumn(
        "label", F.coalesce("label", F.lit("(none)"))).orderBy("topic")


def flag_posts(df: DataFrame, text_col: str = "text", categories: Categories = fixed.PATTERN_CATEGORIES) -> DataFrame:
    """Adds ``flagged``, ``categories`` and ``terms`` to a frame of texts."""
    return df.withColumn("_match", pattern_match(F.col(text_col), categories)).select("*", "_match.*").drop("_match")
