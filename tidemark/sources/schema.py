"""The post schema and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import is_blank


class SchemaError(ValueError):
    """The frame does not hold valid posts."""


def require_columns(df: DataFrame, columns=fixed.POST_COLUMNS, what: str = "posts") -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise SchemaError(f"{what}: missing columns {', '.join(missing)}")


def drop_blank(df: DataFrame) -> DataFrame:
    return df.filter(~is_blank(F.col("text")))


def post_violations(df: DataFrame, blank: Column | None = None) -> DataFrame:
    """One row: posts, blank texts, posts without a valid time, ids used more than once.

    The last two look at non-blank posts only. One pass and one exchange, of ids and not of texts; the
    partial aggregation keeps a very frequent id to one row per task. With ``blank``, a flag of the posts, no text
    is needed.
    """
    if blank is None:
        require_columns(df)
        blank = is_blank(F.col("text"))
    per_id = (
        df.select("post_id", "created_at", blank.alias("blank"))
        .groupBy("post_id")
        .agg(
            F.count_if("blank").alias("blank"),
            F.count_if(~F.col("blank")).alias("kept"),
            F.count_if(~F.col("blank") & F.col("created_at").isNull()).alias("untimed"),
        )
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint")
    return per_id.agg(
        (total("blank") + total("kept")).alias("posts"),
        total("blank").alias("blank_texts"),
        total("untimed").alias("bad_times"),
        F.count_if(F.col("kept") > 1).alias("repeated_ids"),
    )


def check_posts(df: DataFrame, blank: Column | None = None) -> None:
    """Raises on a missing column, an invalid time or a repeated id."""
    found = post_violations(df, blank).first()
    if found.bad_times:
        raise SchemaError(f"{found.bad_times} posts have no valid time")
    if found.repeated_ids:
        raise SchemaError(f"{found.repeated_ids} post ids occur more than once")


def validate_posts(df: DataFrame) -> DataFrame:
    """Non-blank posts, checked."""
    check_posts(df)
    return drop_blank(df)
