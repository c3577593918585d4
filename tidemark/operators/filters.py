"""The rule cascade: every post is charged to the first rule it fails.

Rules in order: ``empty``, ``repeated_author_text``, ``duplicate_text``, ``not_english``, ``spam_pattern``.

No window and no join. Copies are first counted per (text key, author), then per text key, each time with
partial aggregation, so a text that makes up a third of all posts shrinks to one row per task before
anything is exchanged. The group itself carries its first post along; that post is the survivor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import dedupe_key, is_english, is_spam
from ..storage import as_table

RULES = ("empty", "repeated_author_text", "duplicate_text", "not_english", "spam_pattern")
_EVERY_PERIOD = "all"


@dataclass
class FilterResult:
    """``survivors`` (posts), ``removed`` (rule, period, removed) and ``totals`` (rows_in, rows_out)."""

    survivors: DataFrame
    removed: DataFrame
    totals: DataFrame


def text_facts(text: Column) -> dict[str, Column]:
    """What the rules need of a text, by the column names under which ``apply_filters`` finds it."""
    text = F.coalesce(text, F.lit(""))
    key = dedupe_key(text)
    return {"_key": F.unhex(F.sha2(key, 256)), "_blank": key == "", "_english": is_english(text), "_spam": is_spam(text)}


def _key_table(
    df: DataFrame, max_copies: int, order_by: Sequence[str], carry: Sequence[str], periods: Sequence[str]
) -> DataFrame:
    """One row per text key: counts per period of author copies and of other posts, and the first other post."""
    post = F.struct(*order_by, *[name for name in carry if name not in order_by])
    period = F.col("period") if "period" in df.columns else F.lit(_EVERY_PERIOD)
    # a missing author is no author, a missing text a blank one
    author = F.coalesce(F.col("author_hash"), F.lit("")) if "author_hash" in df.columns else F.lit("")
    facts = {name: F.col(name) for name in ("_key", "_blank")} if "_key" in df.columns else text_facts(F.col("text"))
    rows = df.select(
        facts["_key"].alias("key"), facts["_blank"].alias("blank"), author.alias("author"), period.alias("_period"), post.alias("post"))
    per_author = rows.groupBy("key", "blank", "author").agg(
        *[F.count_if(F.col("_period") == name).alias(f"n_{name}") for name in periods], F.min("post").alias("post")
    )
    copies = sum((F.col(f"n_{name}") for name in periods), F.lit(0))
    bot = ~F.col("blank") & (F.col("author") != "") & (copies > max_copies)
    per_key = per_author.select("*", bot.alias("bot")).groupBy("key", "blank").agg(
        *[F.sum(F.when(F.col("bot"), F.col(f"n_{name}")).otherwise(0)).alias(f"bot_{name}") for name in periods],
        *[F.sum(F.when(~F.col("bot"), F.col(f"n_{name}")).otherwise(0)).alias(f"other_{name}") for name in periods],
        F.min(F.when(~F.col("bot"), F.col("post"))).alias("post"),
    )
    return per_key


def _removed(keys: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Long report from one pass over the key table. Rules without removals are left out."""
    first = F.when(F.col("post").isNotNull(), F.col("post._period"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    cells = []
    for name in periods:
        bots, others, here = F.col(f"bot_{name}"), F.col(f"other_{name}"), first == name
        visible = ~F.col("blank")
        amounts = {
            "empty": F.when(F.col("blank"), bots + others),
            "repeated_author_text": F.when(visible, bots),
            "duplicate_text": F.when(visible, others - F.coalesce(here, F.lit(False)).cast("int")),
            "not_english": F.when(here & (F.col("rule") == "not_english"), 1),
            "spam_pattern": F.when(here & (F.col("rule") == "spam_pattern"), 1),
        }
        cells += [
            F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("period"), total(amount).alias("removed"))
            for rule, amount in amounts.items()
        ]
    return keys.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).filter("removed > 0")


def apply_filters(
    df: DataFrame,
    max_copies: int = fixed.COPIES_PER_AUTHOR,
    order_by: Sequence[str] = ("created_at", "post_id"),
    keep: Sequence[str] | None = None,
    materialize: bool = False,
) -> FilterResult:
    """Runs the cascade.

    Of equal texts the first by ``order_by`` stays; the order must be unique to be meaningful, and any tie is
    broken by the remaining columns, so the result never depends on the partitioning.

    ``keep`` names the columns of the survivors (all by default). Without ``text`` in it no text is exchanged:
    the tests of the text run in the scan and only their outcome travels. ``materialize`` writes the key table
    to the shared folder, for callers that use both survivors and report. A frame with the columns of ``text_facts``
    needs no text.
    """
    keep = list(keep or df.columns)
    known = "_key" in df.columns
    periods = list(fixed.PERIODS) if "period" in df.columns else [_EVERY_PERIOD]
    order_by = [name for name in order_by if name in df.columns]
    period = F.col("period") if "period" in df.columns else F.lit(_EVERY_PERIOD)
    late = "text" in keep and not known
    if not late and not known:
        df = df.withColumns(text_facts(F.col("text")))
    facts = text_facts(F.col("text")) if late else {name: F.col(name) for name in ("_english", "_spam")}
    carry = keep + ([] if late else ["_english", "_spam"])
    keys = _key_table(df.withColumn("_period", period), max_copies, order_by, [*carry, "_period"], periods)
    keys = keys.select("*", "post.*") if late else keys.select("*", "post._english", "post._spam")
    rule = (
        F.when(F.col("blank"), "empty")
        .when(F.col("post").isNull(), "repeated_author_text")
        .when(~facts["_english"], "not_english")
        .when(facts["_spam"], "spam_pattern")
    )
    graded = keys.withColumn("rule", rule).select(
        "blank", "post", "rule", *[f"{kind}_{name}" for name in periods for kind in ("bot", "other")]
    )
    if materialize:
        graded = as_table(graded, "rules")
    counts = sum((F.col(f"bot_{n}") + F.col(f"other_{n}") for n in periods), F.lit(0))
    totals = graded.agg(
        F.coalesce(F.sum(counts), F.lit(0)).cast("bigint").alias("rows_in"),
        F.count_if(F.col("rule").isNull()).alias("rows_out"),
    )
    survivors = graded.filter(F.col("rule").isNull()).select(*[F.col("post")[name].alias(name) for name in keep])
    return FilterResult(survivors, _removed(graded, periods), totals)
