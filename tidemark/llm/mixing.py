"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 64-bit hash. Words are summed by source and hash bucket; running sums find the bucket in
which a source reaches its budget, and only that bucket is divided again, a digit of the hash at a time. The
outcome is one threshold per source, so the mix itself is a filter: no document is sorted or ranked, and a source
that holds a third of all rows is only a few thousand sums.

Budgets: all sizes times ``share`` are divided by source weight; a target stops at ``most`` times its source's size
and the excess goes to the others by weight until none is above.

Defined results: a null text has size 0; a null source is a source of its own, last in the order; null ids are hashed
like any value; rows with the same id and text share one hash and are taken together; sources without words have
target 0; an empty table gives an empty table. Columns of the input with a name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.storage import as_table

from .names import Columns
from .quality import words_of

#: bits of the hash that one histogram resolves, and the number of digits
DIGIT_BITS = 12
DIGITS = 5
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: columns that the mix adds
NAMES = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def position_hash(*columns: Column, seed: int = 0) -> Column:
    """A hash in [0, 2^60), the same in each run."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 4)


def _digit(hash_: Column, level: int) -> Column:
    return F.shiftright(hash_, DIGIT_BITS * (DIGITS - 1 - level)).bitwiseAND((1 << DIGIT_BITS) - 1)


def weighted_sources(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight), weights dealt to the sources in code point order, a null source last.

    The order comes from a range sort over one row per source, so its work is spread as well.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sources.orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)])))
    return sizes.sparkSession.createDataFrame(numbered, "source string, source_size long, weight double")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` with ``target``: min(most * size, level * weight) for the one level that spends the budget.

    Every step sums over the sources and raises the level; a source that has reached its end stays there, so the
    steps end after as many rounds as sources can reach theirs, in practice a few.
    """
    end = F.col("source_size") * most
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = min(share, most) * budget
    level = 0.0
    while budget:
        full = end <= F.col("weight") * level
        spent, weight = sources.agg(
            F.sum(F.when(full, end).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        higher = (budget - spent) / weight
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sources.withColumn("target", F.least(end, F.col("weight") * level).cast("double"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): ``whole`` copies of each document, one more of those whose hash is
    less than ``below``.

    ``sizes`` (source, size, hash) is read once for each digit, after the first digit only in the boundary buckets.
    """
    state = wanted.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        .alias("whole"),
    ).select(
        "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("below"))
    for level in range(DIGITS):
        left = DIGIT_BITS * (DIGITS - level)
        bucket = DIGIT_BITS * (DIGITS - 1 - level)
        inside = sizes.alias("d").join(
            state.alias("t"),
            F.col("d.source").eqNullSafe(F.col("t.source"))
            & (F.shiftright("d.hash", left) == F.shiftright("t.below", left))
            & (F.col("t.rest") > 0))
        histogram = inside.groupBy(F.col("d.source").alias("source"), _digit(F.col("d.hash"), level).alias("digit")).agg(
            F.sum("d.size").alias("words"), F.first("t.rest").alias("rest"))
        order = W.partitionBy("source").orderBy("digit")
        running = histogram.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
        last = level == DIGITS - 1
        # the digit in which the running sum goes above the rest; empty digits before it are passed over
        crossing = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("digit", "before", "upto", "rest")))
        found = running.groupBy("source").agg(
            crossing.alias("x"), F.max("digit").alias("last_digit"), F.max("upto").alias("all"))
        # the last digit is one hash: its documents are taken if that ends nearer to the target
        nearer = F.lit(last) & (F.col("x.upto") - F.col("x.rest") <= F.col("x.rest") - F.col("x.before"))
        step = found.select(
            "source",
            F.when(F.col("x").isNull(), F.col("last_digit") + 1).when(nearer, F.col("x.digit") + 1).otherwise(F.col("x.digit")).alias("first_open"),
            F.when(F.col("x").isNull(), F.col("all")).when(nearer, F.col("x.upto")).otherwise(F.col("x.before")).alias("taken"))
        state = as_table(state.alias("t").join(step.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left").select(
            "t.source", "t.source_size", "t.target", "t.whole",
            (F.col("t.rest") - F.coalesce("s.taken", F.lit(0))).alias("rest"),
            (F.col("t.below") + F.shiftleft(F.coalesce("s.first_open", F.lit(0)).cast("long"), bucket)).alias("below")), f"mix-{level}")
    return state.drop("rest")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        seed: int = 0, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies and taken (size times copies).

    Counting words is done once, into a slim table; the texts are read again only for the result.
    """
    given = Columns(docs)
    hash_ = position_hash(given[id_column], F.coalesce(given[text], F.lit("")), seed=seed)
    counted = given.frame.select(*given.neutral(), given[source].cast("string").alias("source"), n_words(given[text]).alias("size"), hash_.alias("hash"))
    slim = as_table(counted.select("source", "size", "hash"), "mix-sizes")
    state = thresholds(slim, targets(as_table(weighted_sources(slim, weights), "mix-sources"), share, most))
    return _taken(counted, state).select(*given.back(NAMES), *NAMES)


def _taken(counted: DataFrame, state: DataFrame) -> DataFrame:
    copies = F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    joined = counted.join(state.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: int = 0) -> DataFrame:
    """What ``mix`` decides, without the texts: doc_id, size, source_size, target, copies, taken."""
    hash_ = position_hash(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), seed=seed)
    slim = as_table(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), hash_.alias("hash")), "mix-sizes")
    state = thresholds(slim, targets(as_table(weighted_sources(slim, weights), "mix-sources"), share, most))
    return _taken(slim, state).select(
        "doc_id", "size", "source_size", "target", "copies", "taken")


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes."""
    given = Columns(mixed.where("copies > 0"))
    copies = F.explode(F.sequence(F.lit(1), given["copies"].cast("int"))).alias("copy")
    return given.frame.select(*given.neutral(), copies).select(*given.back(NAMES))
