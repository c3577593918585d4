"""Counts, shares, differences and the chi-square test. All inputs shrink in one aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.intervals import newcombe, wilson
from ..sizes import settle

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


class NotCountsError(ValueError):
    """The table does not hold counts of at least two rows and two columns."""


def contingency(df: DataFrame, row: str, col: str, col_order: Sequence | None = None, n: str | None = None) -> DataFrame:
    """Long counts ``(row, col, n)``. With ``col_order`` exactly these columns, in this order, zeros included.

    ``n`` names a count column if ``df`` is a table of counts already.
    """
    weight = F.col(n) if n else F.lit(1)
    df = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    if col_order is None:
        return df.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.sum(weight).cast("bigint").alias("n"))
    cells = [
        F.struct(F.lit(level).alias("col"),
                 F.sum(F.when(F.col(col) == F.lit(level), weight).otherwise(0)).cast("bigint").alias("n"))
        for level in col_order
    ]
    return df.groupBy(F.col(row).alias("row")).agg(F.array(*cells).alias("cells")).select("row", F.inline("cells"))


def contingency_wide(df: DataFrame, row: str, col: str, col_order: Sequence) -> DataFrame:
    """The same counts with one column per level, for presentation."""
    return df.groupBy(row).pivot(col, list(col_order)).count().na.fill(0)


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x), the upper part of the incomplete gamma function.

    Below the mean the power series of the lower part converges, above it the continued fraction of the upper part;
    either stops when a term no longer counts, after some multiple of the root of ``dof`` terms.
    """
    if dof == 0 or x <= 0:
        return 1.0
    a, y = dof / 2, x / 2
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= y / k
            total += term
        return min(1.0, max(0.0, 1 - scale * total))
    # the fraction as a ratio of two sequences, kept near 1 by dividing both
    before, here, before_q, here_q, value, n = 0.0, 1.0, 1.0, y + 1 - a, 0.0, 0
    while True:
        ratio = here / here_q
        if abs(ratio - value) <= 1e-15 * abs(ratio):
            return min(1.0, max(0.0, scale * ratio))
        value, n = ratio, n + 1
        weight, step = n * (a - n), y + 1 - a + 2 * n
        before, here = here, step * here + weight * before
        before_q, here_q = here_q, step * here_q + weight * before_q
        size = abs(here_q) or 1.0
        before, here, before_q, here_q = before / size, here / size, before_q / size, here_q / size


def chi_square(table: DataFrame, row: str = "row", col: str = "col", n: str = "n") -> DataFrame:
    """One row: ``chi2, dof, p_value, cramers_v, n, min_expected`` of a long table of counts.

    Cells that are not listed count as zero; columns without any count are dropped. Row and column totals are
    aggregates that join back to the cells, so a table may have very many columns. Raises where the values
    are not counts or the table is too small.
    """
    spark = table.sparkSession
    whole = table.schema[n].dataType.simpleString() in INTEGRAL
    cells = settle(table.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(n).alias("n")), "cells")
    value = F.col("n").cast("double")
    off = F.lit(False) if whole else F.abs(value - F.rint(value)) > 1e-8 + 1e-5 * F.abs(F.rint(value))
    shape = cells.agg(
        F.count_if((value < 0) | off).alias("bad"), F.sum(value).alias("n"), F.count_distinct("row").alias("rows"),
        F.count_distinct("col").alias("cols"), F.count_distinct(F.when(value > 0, F.col("row"))).alias("rows_left"),
        F.count_distinct(F.when(value > 0, F.col("col"))).alias("cols_left"),
    ).first()
    if shape.bad:
        raise NotCountsError("a chi-square test needs non-negative whole counts, not shares")
    if not shape.n or shape.n < 1 or min(shape.rows, shape.cols) < 2:
        raise NotCountsError("a chi-square test needs two rows, two columns and one count at least")
    if shape.rows_left < shape.rows:
        raise NotCountsError("a row of the table has no counts")
    total = float(shape.n)
    by_row = cells.groupBy("row").agg(F.sum(value).alias("of_row"))
    by_col = cells.groupBy("col").agg(F.sum(value).alias("of_col")).filter("of_col > 0")
    expected = F.col("of_row") * F.col("of_col") / total
    fit = cells.join(by_row, "row").join(by_col, "col").agg(
        F.sum(F.pow(value - expected, 2) / expected).alias("listed"), F.sum(expected).alias("covered"),
        F.min("of_row").alias("row"), F.min("of_col").alias("col")).first()
    # an unlisted cell adds its expected count
    chi2 = fit.listed + (total - fit.covered if abs(total - fit.covered) > 1e-9 * total else 0.0)
    dof = (shape.rows - 1) * (shape.cols_left - 1)
    smaller = min(shape.rows, shape.cols_left) - 1
    v = math.sqrt(chi2 / (total * smaller)) if smaller else None
    return spark.createDataFrame(
        [(float(chi2), int(dof), chi_square_tail(chi2, dof), v, int(total), fit.row * fit.col / total)],
        "chi2 double, dof bigint, p_value double, cramers_v double, n bigint, min_expected double",
    )


def sentiment_shares(df: DataFrame, n: str | None = None, labels: Sequence[str] = fixed.SENTIMENTS) -> DataFrame:
    """``period, sentiment, count, share, ci_low, ci_high`` with zero rows for absent labels."""
    weight = F.col(n) if n else F.lit(1)
    counts = [
        F.struct(F.lit(label).alias("sentiment"),
                 F.sum(F.when(F.col("sentiment") == label, weight).otherwise(0)).cast("bigint").alias("count"))
        for label in labels
    ]
    long = df.groupBy("period").agg(F.sum(weight).alias("of"), F.array(*counts).alias("cells")).select(
        "period", "of", F.inline("cells"))
    low, high = wilson(F.col("count"), F.col("of"))
    return long.select("period", "sentiment", "count", (F.col("count") / F.col("of")).alias("share"),
                       low.alias("ci_low"), high.alias("ci_high"))


def share_difference(df: DataFrame, flag: Column, n: str | None = None) -> DataFrame:
    """One row: share of a 0/1 flag in both periods, post minus pre, and its Newcombe bounds.

    No row where a period is empty.
    """
    weight = F.col(n) if n else F.lit(1)

    def amount(period: str, value) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == period, value * weight)), F.lit(0)).cast("bigint")

    sums = df.agg(
        *[amount(p, F.lit(1)).alias(f"{p}_n") for p in fixed.PERIODS],
        *[amount(p, flag.cast("int")).alias(f"{p}_x") for p in fixed.PERIODS],
    ).filter("pre_n > 0 and post_n > 0")
    diff, low, high = newcombe(F.col("pre_x"), F.col("pre_n"), F.col("post_x"), F.col("post_n"))
    return sums.select(
        "pre_n", "pre_x", "post_n", "post_x", (F.col("pre_x") / F.col("pre_n")).alias("pre"),
        (F.col("post_x") / F.col("post_n")).alias("post"), diff.alias("diff"),
        low.alias("diff_low"), high.alias("diff_high"),
    )


def mean_differences(df: DataFrame, features: Mapping[str, Column]) -> DataFrame:
    """Standardized mean difference (post minus pre) of every feature, all in one pass.

    0 where a period has fewer than two values or nothing varies.
    """
    sides = {p: F.col("period") == p for p in fixed.PERIODS}
    values = df.select("period", *[column.cast("double").alias(name) for name, column in features.items()])
    rows = []
    for name in features:
        inside = {p: F.when(side, F.col(name)) for p, side in sides.items()}
        spread = F.sqrt((F.var_samp(inside["pre"]) + F.var_samp(inside["post"])) / 2)
        smd = (F.avg(inside["post"]) - F.avg(inside["pre"])) / F.when(spread > 0, spread)
        rows.append(F.struct(F.lit(name).alias("feature"), F.coalesce(smd, F.lit(0.0)).alias("smd")))
    return values.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def truth_check(scored: DataFrame) -> DataFrame:
    """One row: precision and recall of the flags and accuracy of the sentiment, against ``true_*`` columns."""
    truth = F.col("true_moderation").try_cast("double")
    hits = F.count_if((F.col("moderation") == 1) & (truth == 1))
    right = F.coalesce((F.col("sentiment") == F.col("true_sentiment")).cast("int"), F.lit(0))
    return scored.agg(
        (hits / F.greatest(F.lit(1), F.sum("moderation"))).alias("moderation_precision"),
        (hits / F.greatest(F.lit(1), F.sum(truth).cast("bigint"))).alias("moderation_recall"),
        F.avg(right).alias("sentiment_accuracy"),
    )


def evaluate_flags(checked: DataFrame, flags: Mapping[str, Column], label: str = "label") -> DataFrame:
    """One row per flag: counts, precision, recall, F1 and Wilson bounds, from a single pass over the check set."""
    columns = {f"_f{i}": flag for i, flag in enumerate(flags.values())}
    marked = checked.select(F.col(label).alias("_label"), *[flag.cast("int").alias(c) for c, flag in columns.items()])
    truth = F.col("_label") == 1
    results = []
    for name, column in zip(flags, columns):
        hit = F.col(column) == 1
        results.append(F.struct(
            F.lit(name).alias("flag"), F.count("*").alias("n"), F.count_if(hit & truth).alias("tp"),
            F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn")))
    counts = marked.agg(F.array(*results).alias("rows")).select(F.inline("rows"))
    flagged, positive = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    precision = F.col("tp") / F.when(flagged > 0, flagged)
    recall = F.col("tp") / F.when(positive > 0, positive)
    p_low, p_high = wilson(F.col("tp"), flagged)
    r_low, r_high = wilson(F.col("tp"), positive)
    return counts.select(
        "*", precision.alias("precision"), recall.alias("recall"),
        F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)).alias("f1"),
        p_low.alias("precision_low"), p_high.alias("precision_high"),
        r_low.alias("recall_low"), r_high.alias("recall_high"),
    )


def wrong_flags(checked: DataFrame, flag: Column, label: str = "label") -> DataFrame:
    """The texts a flag gets wrong: ``kind`` (false_positive, false_negative) and ``text``."""
    hit, truth = flag.cast("int") == 1, F.col(label) == 1
    kind = F.when(hit & ~truth, "false_positive").when(~hit & truth, "false_negative")
    return checked.select(kind.alias("kind"), "text").filter(F.col("kind").isNotNull())
