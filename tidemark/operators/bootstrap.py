"""Direct standardization, topic prevalence, and their percentile bootstrap.

Both statistics depend only on the counts per (period, stratum, outcome). Resampling the posts of a period
with replacement is one multinomial draw over its cells, so the posts are read once, for the cell counts.

Strata fall into 65,536 buckets by hash. The total of a period is split between the halves of the buckets by a binomial
draw, each half again, down to the buckets, and a bucket's total is one multinomial draw over its cells: together the
same distribution. Every split has a generator seed of its own, so it comes out alike wherever it is made. A task draws
one block of buckets: the splits on the way to it, as many as the logarithm of the blocks, and those inside. Hence the
intervals depend on neither partitioning nor the size of blocks, and strata without bound spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sizes import settle

#: cells that are drawn together, and replicates that share a task
CELLS_PER_BLOCK, REPLICATES_PER_RUN = 20_000, 100
#: bits of a stratum's hash that number its bucket
BUCKET_BITS = 16
QUANTILES = (0.025, 0.975)


def outcome_cells(df: DataFrame, outcome: str, stratum: str, n: str | None = None) -> DataFrame:
    """``period, stratum, outcome, n``; posts without a stratum have null there."""
    weight = F.col(n) if n else F.lit(1)
    return df.groupBy(
        "period", F.col(stratum).cast("string").alias("stratum"), F.col(outcome).cast("int").alias("outcome")
    ).agg(F.sum(weight).cast("bigint").alias("n"))


def _stratum_counts(cells: DataFrame) -> DataFrame:
    def amount(period: str, value) -> F.Column:
        return F.sum(F.when(F.col("period") == period, value).otherwise(0)).cast("bigint")

    return cells.groupBy("stratum").agg(
        *[amount(p, F.col("n")).alias(f"{p}_n") for p in fixed.PERIODS],
        *[amount(p, F.col("n") * F.col("outcome")).alias(f"{p}_x") for p in fixed.PERIODS],
    )


class _Splits:
    """Totals of one period and run of replicates, split down a binary tree over buckets."""

    def __init__(self, seed: int, run: int, period: int):
        self.key = (seed, run, period)

    def generator(self, *place: int) -> np.random.Generator:
        seed, run, period = self.key
        return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(run, period, *place)))

    def down(self, totals: np.ndarray, places: np.ndarray, weights: np.ndarray, bits: int, wanted: int | None = None):
        """(place, totals) of each of the ascending ``places`` of ``bits`` bits, or of the wanted one alone."""
        upto = np.concatenate([[0.0], np.cumsum(weights)])
        todo = [(0, len(places), totals)]
        while todo:
            a, b, n = todo.pop()
            if a == b or wanted is not None and not places[a] <= wanted <= places[b - 1]:
                continue
            if b - a == 1:
                yield int(places[a]), n
                continue
            # the first bit in which the places differ; halves without a place are passed over
            low = int(places[a] ^ places[b - 1]).bit_length() - 1
            prefix = int(places[b - 1]) >> low
            middle = int(np.searchsorted(places, prefix << low))
            left = self.generator(BUCKET_BITS - bits + low, prefix).binomial(n, (upto[middle] - upto[a]) / (upto[b] - upto[a]))
            todo += [(middle, b, n - left), (a, middle, left)]


def _redraw(
    cells: DataFrame, statistic: Callable[[np.ndarray, pd.DataFrame, int], pd.DataFrame], schema: str, n_boot: int, seed: int,
    cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """``statistic`` of every block and run of replicates.

    It gets the drawn counts of a block, replicate by cell, the cells themselves, ordered by stratum, and the number
    of the first replicate.
    """
    bits = min(BUCKET_BITS, max(0, math.ceil(math.log2(max(1, cells.count()) / cells_per_block))))
    inner = BUCKET_BITS - bits
    placed = cells.withColumn("bucket", F.shiftrightunsigned(F.xxhash64("stratum"), 64 - BUCKET_BITS).cast("int")).withColumn(
        "block", F.shiftright("bucket", inner))
    found = placed.groupBy("period", "block").agg(F.sum("n").alias("n")).collect()  # two rows per block, 131,072 at most
    totals = {}
    for period in fixed.PERIODS:
        mine = sorted((row["block"], row["n"]) for row in found if row["period"] == period and row["n"])
        totals[period] = np.array([b for b, _ in mine], np.int64), np.array([n for _, n in mine], float)
    runs = placed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(n_boot - 1, 0)), F.lit(REPLICATES_PER_RUN))))

    def draw(block_cells: pd.DataFrame) -> pd.DataFrame:
        block_cells = block_cells.sort_values(["bucket", "stratum", "outcome", "period"], na_position="first", ignore_index=True)
        block, first = int(block_cells["block"].iloc[0]), int(block_cells["first"].iloc[0])
        replicates = min(REPLICATES_PER_RUN, n_boot - first)
        counts = np.zeros((replicates, len(block_cells)))
        for number, (period, (blocks, sizes)) in enumerate(totals.items()):
            at = np.flatnonzero((block_cells["period"] == period) & (block_cells["n"] > 0))
            if not len(at):
                continue
            splits = _Splits(seed, first, number)
            n = block_cells["n"].to_numpy(dtype=float)[at]
            bucket = block_cells["bucket"].to_numpy(dtype=np.int64)[at]
            buckets, start = np.unique(bucket, return_index=True)
            size = np.full(replicates, int(sizes.sum()))
            (_, size), = splits.down(size, blocks, sizes, bits, block)
            for place, total in splits.down(size, buckets, np.add.reduceat(n, start), BUCKET_BITS):
                inside = at[bucket == place]
                share = block_cells["n"].to_numpy(dtype=float)[inside]
                counts[:, inside] = splits.generator(BUCKET_BITS, place).multinomial(total, share / share.sum())
        return statistic(counts, block_cells, first)

    return runs.groupBy("block", "first").applyInPandas(draw, schema)


def _by_stratum(counts: np.ndarray, cells: pd.DataFrame, chosen: pd.Series, codes: np.ndarray, strata: int) -> np.ndarray:
    """Drawn counts of the chosen cells, replicate by stratum."""
    at = np.flatnonzero(chosen)
    place = np.zeros((len(at), strata))
    place[np.arange(len(at)), codes[at]] = 1
    return counts[:, at] @ place if strata <= 64 else np.stack(
        [np.bincount(codes[at], weights=row[at], minlength=strata) for row in counts])


def standardized_difference(
    df: DataFrame, outcome: str, stratum: str, n_boot: int = fixed.BOOTSTRAP_DRAWS, seed: int = fixed.SEED,
    n: str | None = None, cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """One row: crude and standardized post-minus-pre difference of a 0/1 outcome, with the bootstrap interval.

    The rates of each stratum are weighted by its share of all posts; strata missing in a period drop out and
    the weights are scaled up. ``n_boot = 0`` gives the point alone.
    """
    cells = settle(outcome_cells(df, outcome, stratum, n), "cells")
    point = _standardized_point(cells)
    if not n_boot:
        return point

    def estimate(counts: np.ndarray, block_cells: pd.DataFrame, first: int) -> pd.DataFrame:
        codes, strata = pd.factorize(block_cells["stratum"])
        known = pd.Series(codes >= 0)  # posts without a stratum are resampled but not weighted
        side = {p: known & (block_cells["period"] == p) for p in fixed.PERIODS}
        size = {p: _by_stratum(counts, block_cells, side[p], codes, len(strata)) for p in side}
        hits = {p: _by_stratum(counts, block_cells, side[p] & (block_cells["outcome"] == 1), codes, len(strata))
                for p in side}
        both = (size["pre"] > 0) & (size["post"] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.where(both, hits["post"] / size["post"] - hits["pre"] / size["pre"], 0.0)
        weight = np.where(both, size["pre"] + size["post"], 0.0)
        return pd.DataFrame({"replicate": np.arange(first, first + len(counts)), "total": (weight * change).sum(axis=1),
                             "covered": weight.sum(axis=1)})

    draws = _redraw(cells, estimate, "replicate int, total double, covered double", n_boot, seed, cells_per_block)
    estimates = draws.groupBy("replicate").agg(F.sum("total").alias("t"), F.sum("covered").alias("c")).select(
        (F.col("t") / F.when(F.col("c") > 0, F.col("c"))).alias("estimate"))
    bounds = estimates.agg(F.percentile("estimate", F.array(*map(F.lit, QUANTILES))).alias("q")).select(
        F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    return point.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _standardized_point(cells: DataFrame) -> DataFrame:
    by_stratum = _stratum_counts(cells)
    known = F.col("stratum").isNotNull() & (F.col("pre_n") > 0) & (F.col("post_n") > 0)
    weight = F.when(known, F.col("pre_n") + F.col("post_n"))
    change = F.col("post_x") / F.col("post_n") - F.col("pre_x") / F.col("pre_n")
    sums = by_stratum.agg(
        *[F.sum(name).alias(name) for name in ("pre_n", "pre_x", "post_n", "post_x")],
        F.sum(F.when(known, weight * change)).alias("total"), F.sum(weight).alias("covered"),
    )
    return sums.select(
        (F.col("post_x") / F.when(F.col("post_n") > 0, F.col("post_n"))
         - F.col("pre_x") / F.when(F.col("pre_n") > 0, F.col("pre_n"))).alias("crude_diff"),
        (F.col("total") / F.when(F.col("covered") > 0, F.col("covered"))).alias("standardized_diff"),
    )


def topic_prevalence(
    df: DataFrame, topic: str = "topic", n_boot: int = fixed.BOOTSTRAP_DRAWS, seed: int = fixed.SEED,
    n: str | None = None, cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """``topic, pre_share, post_share, diff`` and, with ``n_boot``, the bounds of the difference, for every topic."""
    weight = F.col(n) if n else F.lit(1)
    kind = df.schema[topic].dataType
    cells = settle(
        df.groupBy("period", F.col(topic).cast("string").alias("stratum")).agg(F.sum(weight).cast("bigint").alias("n"))
        .select("period", "stratum", F.lit(0).alias("outcome"), "n"), "cells")
    sizes = {row["period"]: row["n"] for row in cells.groupBy("period").agg(F.sum("n").alias("n")).collect()}
    size = {p: float(sizes[p]) if sizes.get(p) else None for p in fixed.PERIODS}
    shares = _stratum_counts(cells).select(
        "stratum", *[(F.col(f"{p}_n") / F.lit(size[p]).cast("double")).alias(f"{p}_share") for p in fixed.PERIODS])
    table = shares.withColumn("diff", F.col("post_share") - F.col("pre_share"))
    if n_boot:
        def change(counts: np.ndarray, block_cells: pd.DataFrame, first: int) -> pd.DataFrame:
            # posts without a topic are a row of their own, here as in the point table
            codes, strata = pd.factorize(block_cells["stratum"], use_na_sentinel=False)
            of = {p: _by_stratum(counts, block_cells, block_cells["period"] == p, codes, len(strata)) / size[p]
                  for p in fixed.PERIODS}
            return pd.DataFrame({"stratum": np.tile(pd.array(strata, dtype=object), len(counts)), "d": (of["post"] - of["pre"]).ravel()})

        draws = _redraw(cells, change, "stratum string, d double", n_boot, seed, cells_per_block)
        bounds = draws.groupBy(F.col("stratum").alias("of")).agg(F.percentile("d", F.array(*map(F.lit, QUANTILES))).alias("q"))
        table = table.join(
            bounds.select("of", F.col("q")[0].alias("diff_low"), F.col("q")[1].alias("diff_high")),
            F.col("stratum").eqNullSafe(F.col("of"))).drop("of")
    return table.withColumnRenamed("stratum", "topic").withColumn("topic", F.col("topic").cast(kind))
