"""Exact random samples and the sortedness check.

A post's place in the draw is the MD5 of seed and id, so a sample depends on neither partitioning nor row
order. The input is read twice: once for a histogram of the first hash digits (65,536 buckets) per group, which also
has the sizes of all groups, and once for the rows up to the bucket in which a sample ends. These are the sample and
at most a bucket more; only that last bucket is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..sizes import settle
from ..storage import as_table

_DIGITS = 4


def draw_key(seed: int, id_col: str = "post_id"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def _draw(df: DataFrame, histogram: DataFrame, quotas: DataFrame, by: Sequence[str], seed: int, id_col: str) -> DataFrame:
    """Rows of every group up to its quota. ``quotas`` holds the group columns and ``quota``."""
    upto = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    edges = settle(
        histogram.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .join(quotas, list(by))
        .filter(F.col("_before") < F.col("quota"))
        .groupBy(*by).agg(F.max("_bucket").alias("_edge"), F.min(F.col("quota") - F.col("_before")).alias("_left")), "edges")
    reached = as_table(_keyed(df, seed, id_col).join(edges, list(by)).filter(F.col("_bucket") <= F.col("_edge")), "reached")
    # only the bucket in which the sample ends is ranked
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_hash"))
    last = reached.filter("_bucket = _edge").select(*by, "_hash", "_left").withColumn("_rank", rank).filter("_rank <= _left").groupBy(*by).agg(
        F.max("_hash").alias("_last"))
    return reached.join(settle(last, "cutoffs"), list(by)).filter(F.col("_hash") <= F.col("_last")).select(*df.columns)


def _keyed(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    return df.withColumn("_hash", draw_key(seed, id_col)).withColumn("_bucket", F.substring("_hash", 1, _DIGITS))


def _histogram(df: DataFrame, by: Sequence[str], seed: int, id_col: str) -> DataFrame:
    return as_table(_keyed(df, seed, id_col).groupBy(*by, "_bucket").agg(F.count("*").alias("_n")), "histogram")


def _quotas(histogram: DataFrame, group: str, n: int, stratify: str) -> DataFrame:
    """Rows per (group, stratum) of a proportional sample; halves go to the even number. Null strata have none."""
    sizes = histogram.filter(F.col(stratify).isNotNull()).groupBy(group, stratify).agg(F.sum("_n").alias("_n"))
    of_group = sizes.groupBy(group).agg(F.sum("_n").alias("_of"))
    share = F.col("_n") / F.col("_of")
    return sizes.join(of_group, group).select(
        group, stratify, F.least(F.col("_n"), F.rint(share * n).cast("bigint")).alias("quota"))


def _sample(
    df: DataFrame, histogram: DataFrame, group: str, sizes: dict[str, int], n: int, seed: int, stratify: str | None, id_col: str
) -> DataFrame:
    """``n`` rows of every group, or all rows of a group that has no more."""
    whole = [name for name, size in sizes.items() if size <= n]
    if len(whole) == len(sizes):
        return df
    cut, counted = (x.filter(~F.col(group).isin(whole)) if whole else x for x in (df, histogram))
    if stratify is None:
        quotas = F.broadcast(cut.sparkSession.createDataFrame(
            [(name, n) for name in sizes if name not in whole], f"{group} string, quota bigint"))
        drawn = _draw(cut, counted, quotas, [group], seed, id_col)
    else:
        drawn = _draw(cut, counted, settle(_quotas(counted, group, n, stratify), "quotas"), [group, stratify], seed, id_col)
    return drawn.unionByName(df.filter(F.col(group).isin(whole))) if whole else drawn


def _sizes(histogram: DataFrame, group: str) -> dict[str, int]:
    return {row[0]: row[1] for row in histogram.groupBy(group).agg(F.sum("_n")).collect()}


def sample_posts(
    df: DataFrame, n: int, seed: int = fixed.SEED, stratify: str | None = None, id_col: str = "post_id"
) -> DataFrame:
    """``n`` random rows without replacement; with ``stratify`` every stratum keeps its share."""
    marked = df.withColumn("_group", F.lit("all"))
    histogram = _histogram(marked, ["_group", *([stratify] if stratify else [])], seed, id_col)
    return _sample(marked, histogram, "_group", _sizes(histogram, "_group"), n, seed, stratify, id_col).drop("_group")


def balanced_periods(
    df: DataFrame,
    n_per_period: int = fixed.POSTS_PER_PERIOD,
    seed: int = fixed.SEED,
    stratify: str | None = None,
    id_col: str = "post_id",
) -> DataFrame:
    """The same number of posts from both periods; the smaller period sets the number if it has fewer."""
    histogram = _histogram(df, ["period", *([stratify] if stratify else [])], seed, id_col)
    sizes = _sizes(histogram, "period")
    if set(sizes) != set(fixed.PERIODS):
        raise ValueError(f"both periods are needed, found {', '.join(sorted(map(str, sizes))) or 'none'}")
    return _sample(df, histogram, "period", sizes, min(n_per_period, *sizes.values()), seed, stratify, id_col)


def sortedness(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """One row: ``pairs`` of neighbours in the given order and the share of them with the same value.

    Range partitions are compared inside, then their borders: one small row per partition. A missing value
    equals nothing, as in the other comparisons of this package. ``order_by`` must be unique; a share of 0
    stands for fewer than two rows.
    """
    ordered = df.select(*order_by, F.col(value).cast("string").alias("_value"))
    ordered = ordered.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "_value")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, same, first, last = None, 0, 0, None, None
        for batch in batches:
            if batch.num_rows:
                values = batch.column("_value")
                if rows == 0:
                    part, first = batch.column("part")[0].as_py(), values[0].as_py()
                elif last is not None and last == values[0].as_py():
                    same += 1
                same += pc.sum(pc.equal(values[1:], values[:-1])).as_py() or 0  # a null equals nothing
                last = values[-1].as_py()
                rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "n": pa.array([rows], pa.int64()),
                 "same": pa.array([same], pa.int64()), "first": pa.array([first], pa.string()),
                 "last": pa.array([last], pa.string())})

    parts = ordered.mapInArrow(neighbours, "part int, n bigint, same bigint, first string, last string")
    # one row per partition: this window is as long as the number of tasks
    border = F.coalesce((F.lag("last").over(W.orderBy("part")) == F.col("first")).cast("bigint"), F.lit(0))
    totals = parts.withColumn("border", border).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("same") + F.col("border")).alias("same"))
    return totals.select(
        F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("pairs"),
        F.when(F.col("n") > 1, F.col("same") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("sortedness"),
    )
