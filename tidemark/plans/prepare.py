"""Posts -> period -> rule cascade -> balanced sample -> light view, and the manifest of the run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import is_blank, light_clean
from ..functions.times import assign_period
from ..operators.filters import FilterResult, apply_filters, text_facts
from ..operators.sampling import balanced_periods, draw_key, sortedness
from ..sizes import BROADCAST_ROWS
from ..sources.schema import check_posts, drop_blank, require_columns
from ..storage import as_table


def prepare(
    posts: DataFrame,
    cutoff: date = fixed.CUTOFF,
    n_per_period: int = fixed.POSTS_PER_PERIOD,
    seed: int = fixed.SEED,
    validated: bool = False,
    max_copies: int = fixed.COPIES_PER_AUTHOR,
) -> tuple[DataFrame, DataFrame]:
    """The prepared sample and a one-row manifest. ``validated`` says that the reader has checked the posts.

    The texts are scanned twice: once for keys and flags, from which checks, rules and draw work, and once for the texts
    of the sampled ids. No text is exchanged before the sample is known.
    """
    require_columns(posts)
    posts = assign_period(posts, cutoff)
    slim = [name for name in posts.columns if name != "text"]
    facts = posts
    if not validated:
        facts = as_table(posts.select(*slim, *[c.alias(n) for n, c in text_facts(F.col("text")).items()], is_blank(F.col("text")).alias("_no_text")), "facts")
        check_posts(facts, F.col("_no_text"))
        facts, posts = facts.where(~F.col("_no_text")), drop_blank(posts)
    result = apply_filters(facts, max_copies=max_copies, keep=slim, materialize=True)
    drawn = as_table(balanced_periods(result.survivors, n_per_period, seed), "drawn")
    ids = drawn.select("post_id")
    if drawn.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = posts.select("post_id", "text").join(ids, "post_id", "left_semi").withColumn("text", light_clean(F.col("text")))
    sample = as_table(drawn.join(texts, "post_id").select(*posts.columns), "sample")
    return sample, manifest(sample, result, cutoff, seed)


def manifest(sample: DataFrame, result: FilterResult, cutoff: date, seed: int) -> DataFrame:
    """One row of structs and maps: settings, sizes, sources and date range per period, rule counts."""
    per_source = sample.groupBy("period", "source").agg(
        F.count("*").alias("rows"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    per_period = per_source.groupBy("period").agg(
        F.sum("rows").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rows")))).alias("s"),
        F.min("first").alias("first"), F.max("last").alias("last"))

    def by_period(value) -> F.Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("period"), value))))

    periods = per_period.agg(
        F.min("rows").alias("n_per_period"), by_period(F.col("rows")).alias("rows_per_period"),
        F.map_from_entries(F.collect_list(F.struct("period", "s"))).alias("sources_per_period"),
        by_period(F.struct(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last")))
        .alias("date_range"),
    )
    rules = result.removed.groupBy("rule").agg(
        F.map_from_entries(F.collect_list(F.struct("period", "removed"))).alias("by_period"))
    removed = rules.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", F.map_entries("by_period")))))
                        .alias("entries"))
    removed = removed.select(F.transform_values("entries", lambda _, entries: F.map_from_entries(entries)).alias("removed"))
    # three one-row frames side by side
    one = F.lit(1).alias("_one")
    filters = result.totals.select("*", one).join(removed.select("*", one), "_one").select(
        F.struct("rows_in", "removed", "rows_out").alias("filters"), "_one")
    row = periods.select("*", one).join(filters, "_one")
    if "source_label" in sample.columns:
        in_order = sample.withColumn("_place", draw_key(seed))
        sorted_share = sortedness(in_order, "source_label", ["period", "_place"])
        row = row.join(sorted_share.select(F.col("sortedness").alias("source_label_sortedness_in_sample"), one), "_one")
    return row.select(F.lit(cutoff.isoformat()).alias("cutoff"), F.lit(seed).alias("seed"), "*").drop("_one")
