"""Logistic regression by iteratively reweighted least squares over the distinct design rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..storage import as_table

LEAST_WEIGHT = 1e-9
STEP_TOLERANCE = 1e-8
#: sums of tasks that the driver adds at once
SUMS_AT_ONCE = 256


def _equations(x: np.ndarray, n: np.ndarray, hits: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """X'WX for the step, X'WX for the errors and X'(y - mu) at ``beta``, in one flat array."""
    with np.errstate(over="ignore"):
        mu = 1 / (1 + np.exp(-(x @ beta)))
    weight = mu * (1 - mu)
    hessian, information = (x.T @ (x * (n * w)[:, None]) for w in (np.maximum(weight, LEAST_WEIGHT), weight))
    return np.concatenate([hessian.ravel(), information.ravel(), x.T @ (hits - n * mu)])


def _climb(equations: Callable[[np.ndarray], np.ndarray], width: int, max_iter: int, ridge: float) -> tuple:
    """Coefficients and their standard errors."""
    beta, small = np.zeros(width), ridge * np.eye(width)
    for _ in range(max_iter):
        flat = equations(beta)
        hessian, gradient = flat[:width * width].reshape(width, width), flat[2 * width * width:]
        step = np.linalg.solve(hessian + small, gradient - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < STEP_TOLERANCE:
            break
    information = equations(beta)[width * width:2 * width * width].reshape(width, width)
    return beta, np.sqrt(np.diag(np.linalg.inv(information + small)))


def _over_tasks(design: DataFrame, features: Sequence[str]) -> Callable[[np.ndarray], np.ndarray]:
    """The equations at given coefficients, one job each: a task returns sums of the size of the equations, and where there
    are many tasks their sums are added in a second round before the driver adds the rest."""
    many = design.rdd.getNumPartitions() > SUMS_AT_ONCE

    def equations(beta: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for batch in batches:
                column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                x = np.column_stack([np.ones(batch.num_rows), *map(column, features)])
                found.append(_equations(x, column("_n"), column("_hits"), beta))
            if found:
                yield pa.record_batch([pa.array([sum(found).tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [np.frombuffer(blob) for batch in batches for blob in batch.column(0).to_pylist()]
            if found:
                yield pa.record_batch([pa.array([sum(found).tobytes()], pa.binary())], names=["sums"])

        parts = design.mapInArrow(sums, "sums binary")
        if many:
            parts = parts.repartition(SUMS_AT_ONCE).mapInArrow(add, "sums binary")
        return sum((np.frombuffer(blob) for blob in parts.toArrow().column("sums").to_pylist()), np.zeros(_length(len(beta))))

    return equations


def _length(width: int) -> int:
    return 2 * width * width + width


def logistic_regression(
    df: DataFrame, label: str, features: Sequence[str], n: str | None = None, distinct_rows: bool = True,
    max_iter: int = 50, ridge: float = 1e-6,
) -> DataFrame:
    """``term, coef, se, z, p_value, odds_ratio, or_ci_low, or_ci_high``, the intercept first.

    Equal design rows are counted first, so the steps run over the distinct rows; switch ``distinct_rows`` off
    for continuous predictors, where nothing is equal. ``n`` names a count column.
    """
    weight = F.col(n) if n else F.lit(1)
    hits = F.col(label).cast("double") * weight
    columns = [F.col(name).cast("double").alias(name) for name in features]
    if distinct_rows:
        design = df.groupBy(*columns).agg(F.sum(weight).cast("double").alias("_n"), F.sum(hits).alias("_hits"))
    else:
        design = df.select(*columns, weight.cast("double").alias("_n"), hits.alias("_hits"))
    beta, se = _climb(_over_tasks(as_table(design, "design"), features), len(features) + 1, max_iter, ridge)
    rows = []
    for term, coef, error in zip(["intercept", *features], beta, se):
        z = coef / error
        with np.errstate(over="ignore"):
            odds = np.exp([coef, coef - fixed.Z_95 * error, coef + fixed.Z_95 * error])
        rows.append((term, float(coef), float(error), float(z), math.erfc(abs(z) / math.sqrt(2)), *map(float, odds)))
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, se double, z double, p_value double, odds_ratio double, "
              "or_ci_low double, or_ci_high double")


def study_regression(df: DataFrame, outcome: str = "negative", topic: str = "topic", n: str | None = None) -> DataFrame:
    """``outcome ~ post * moderation + topic``; the terms of the topics are fitted and not reported.

    The base topic is the first in string order. It moves the intercept alone. Topics are as few as a model has, so
    their names come to the driver.
    """
    levels = sorted(row[0] for row in df.select(F.col(topic).cast("string")).distinct().collect())
    post = (F.col("period") == "post").cast("int")
    dummies = {f"topic_{level}": (F.col(topic).cast("string") == level).cast("int") for level in levels[1:]}
    design = df.select(
        F.col(outcome), *([F.col(n)] if n else []), post.alias("post"), "moderation",
        (post * F.col("moderation")).alias("post_x_moderation"),
        *[column.alias(name) for name, column in dummies.items()],
    )
    fitted = logistic_regression(design, outcome, ["post", "moderation", "post_x_moderation", *dummies], n)
    return fitted.filter(~F.col("term").startswith("topic_"))
