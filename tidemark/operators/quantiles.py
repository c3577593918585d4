"""Exact quantiles of large groups, without sorting them or holding one in a task.

An order statistic is found by narrowing a range of values around it. Rows of a range are counted in bins of equal
width, with the least and greatest value of each bin; the bin in which the wanted rank lies is the next range. A range
of one value is the result. Every round is one partial aggregation, after which a range is a few thousand rows at most,
and reads only rows inside the open ranges. Values that lie close together cost more rounds, never more memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import as_table

BINS = 4096
#: ranges that every task gets; beyond that the planner joins them by shuffle
MANY_RANGES = 100_000
_LARGEST = 1.7976931348623157e308


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 ... bins - 1, rising with the value; ``low`` falls in the first and ``high`` in the last."""
    wide = high - low == float("inf")
    share = F.when(wide, (value / 2 - low / 2) / (high / 2 - low / 2)).otherwise((value - low) / (high - low))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """``by, n, quantiles array<double>``: per group the number of values and their quantiles, linear between neighbours.

    Null and NaN are left out, a group without other values has no row; infinite values count as the largest number.
    A null group is a group. Without ``by`` there is one row, or none if nothing is left.
    """
    if not probabilities or any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    groups = [f"_g{i}" for i in range(len(by))]
    number = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)], number.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").withColumn(
        "v", F.greatest(F.least("v", F.lit(_LARGEST)), F.lit(-_LARGEST)))
    rows = as_table(rows, "values")
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    at = F.explode(F.array(*[(F.lit(float(p)) * (F.col("n") - 1)) for p in probabilities])).alias("at")
    ranks = sizes.select(*groups, "n", "low", "high", at).select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    # below: values under the range
    state = as_table(ranks.select(*groups, "n", "low", "high", "rank", F.lit(0).cast("long").alias("below")).distinct(), "ranges")
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    while not state.where("low < high").isEmpty():
        ranges = state.where("low < high").select(*groups, "low", "high").distinct()
        few = ranges.count() <= MANY_RANGES
        inside = rows.alias("r").join(
            (F.broadcast(ranges) if few else ranges).alias("s"),
            _all([*same("r", "s", groups), F.col("r.v") >= F.col("s.low"), F.col("r.v") <= F.col("s.high")]))
        counted = inside.groupBy(*[F.col(f"s.{g}") for g in groups], F.col("s.low"), F.col("s.high"), _bin(F.col("r.v"), F.col("s.low"), F.col("s.high"), bins).alias("bin")).agg(
            F.count("*").alias("n"), F.min("r.v").alias("first"), F.max("r.v").alias("last"))
        upto = F.sum("n").over(W.partitionBy(*groups, "low", "high").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        binned = counted.select(*groups, "low", "high", "first", "last", (upto - F.col("n")).alias("before"), upto.alias("upto"))
        place = F.col("t.rank") - F.col("t.below")
        hit = state.alias("t").join(binned.alias("b"), _all([
            *same("t", "b", groups), F.col("t.low") == F.col("b.low"), F.col("t.high") == F.col("b.high"), place >= F.col("b.before"), place < F.col("b.upto")]))
        narrowed = hit.select(*[F.col(f"t.{g}") for g in groups], F.col("t.n"), F.col("b.first").alias("low"), F.col("b.last").alias("high"), F.col("t.rank"),
                              (F.col("t.below") + F.col("b.before")).alias("below"))
        state = as_table(state.where("low = high").unionByName(narrowed), "ranges")
    found = state.groupBy(*groups, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("values"))

    def quantile(p: float) -> Column:
        position = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col("values")[F.floor(position)], F.col("values")[F.ceil(position)]
        return a + (b - a) * (position - F.floor(position))

    return found.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], "n", F.array(*map(quantile, probabilities)).alias("quantiles"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
