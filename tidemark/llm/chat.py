"""Chat formatting in budgeted windows, with DataFrame functions only.

A running sum of turn costs places every turn. Each conversation has its share of the budget for own turns: what the
system turn and the history leave. The sum is cut into strides of that share; the turns that lie inside a stride are one
window, and a turn that reaches over its end is a window by itself. So windows are aligned to turns, never hold more
than the budget, and none depends on how the ones before it came out. A window repeats the system turn of its
conversation and the last turns of the window before it that fit into the history budget; repeated turns are context
and outside the loss mask, so each assistant text is a target once.

The running sum is taken in two steps, over blocks of turn numbers and within a block, and everything after it is
grouped by window, whose size the budget bounds: a conversation that holds a third of all rows is spread like any
other.

Format: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and roles a control string ``<|`` becomes
``<\\|``: a backslash goes behind the ``<`` of every ``<``, backslashes, ``|``, which ``unescaped`` takes out again.
In roles backslashes and line ends are written ``\\\\`` and ``\\n`` as well.

Defined results: null text and null role are empty; a null ``conv_id`` is a conversation; rows with equal turn
numbers are ordered by role and text, null turns first; a turn larger than its share is a window of its own, whole and
without history, and costs more than the budget only if that turn and the system turn do; a system turn that takes half
of the budget leaves no history, one that takes all of it is repeated all the same; an empty table gives an empty table; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.storage import as_table

START, END = "<|im_start|>", "<|im_end|>"
TURNS_PER_BLOCK = 256
BUDGET, HISTORY = 1024, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    # each backslash pair or \n is read once, from the left: pairs are parked on a character no role can hold here
    plain = unescaped(role)
    parked = F.replace(plain, F.lit("\\\\"), F.lit("\n"))
    back = F.split(parked, "\n")
    return F.array_join(F.transform(back, lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def token_estimate(text: Column) -> Column:
    """Runs of letters and digits in pieces of up to six characters, and every other visible character."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,6}|[^\p{L}\p{N}\s]"))


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def placed_turns(turns: DataFrame, cost: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """conv_id, turn, role, text (escaped), cost, before (running sum)."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "conv_id", "turn", F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("block"),
        escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
        F.col("role").alias("__role"), F.col("text").alias("__text"),
        (cost(F.col("text")) + 5).cast("long").alias("cost"))
    blocks = clean.groupBy("conv_id", "block").agg(F.sum("cost").alias("block_cost"))
    order = W.partitionBy("conv_id").orderBy("block")
    offsets = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        (F.sum("block_cost").over(order) - F.col("block_cost")).alias("offset"))
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "__role", "__text").rowsBetween(W.unboundedPreceding, W.currentRow)
    return clean.withColumns({"within": F.sum("cost").over(inside), "place": F.row_number().over(inside)}).join(
        offsets, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")),
    ).select(
        "conv_id", "turn", "block", "place", "role", "text", "cost",
        (F.col("offset") + F.col("within") - F.col("cost")).alias("before"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                   cost: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_context (turns repeated), n_turns (all turns in it), estimate
    (their cost), loss_spans (code point ranges of the target texts in ``formatted``, end exclusive). Windows are
    numbered in order, with gaps."""
    placed = as_table(placed_turns(turns, cost), "chat-turns")
    # the system turn: the first turn of a conversation, if it has that role
    first = placed.where("before = 0").where(F.col("role") == "system").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("x"), F.col("cost").alias("system"))
    system_cost = F.coalesce("system", F.lit(0))
    kept = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget // 2) - system_cost))
    sized = placed.join(first.select("c", "system"), F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "before", "role", "text", "cost", kept.alias("kept"),
        F.when(system_cost < budget, F.lit(budget) - system_cost - kept).otherwise(max(1, budget // 4)).alias("share"))
    stride, reached = F.floor(F.col("before") / F.col("share")), F.floor((F.col("before") + F.col("cost") - 1) / F.col("share"))
    windowed = sized.withColumn("window", (2 * stride + F.when(reached > stride, 1).otherwise(0)).cast("long"))
    span = W.partitionBy("conv_id", "window")
    ended = as_table(windowed.withColumns(
        {"starts": F.min("before").over(span), "ends": F.max(F.col("before") + F.col("cost")).over(span)}), "chat-windows")
    own = ended.select("conv_id", "window", "before", "role", "text", "cost", F.lit(1).alias("kind"))
    # the turn at the end of a window begins the next one, which takes history if it is not too large itself
    onward = ended.where((F.col("before") == F.col("starts")) & (F.col("cost") <= F.col("share"))).select(
        F.col("conv_id").alias("c"), F.col("starts").alias("at"), F.col("window").alias("onward"))
    carried = ended.where((F.col("ends") - F.col("before")) <= F.col("kept")).join(
        onward, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ends") == F.col("at"))).select(
        "conv_id", F.col("onward").alias("window"), "before", "role", "text", "cost", F.lit(0).alias("kind"))
    later = ended.where("starts > 0").select("conv_id", "window").distinct()
    system = later.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "window", F.lit(0).cast("long").alias("before"), F.col("r").alias("role"), F.col("x").alias("text"), F.col("system").alias("cost"), F.lit(0).alias("kind"))
    # history may hold the system turn too: it is carried once
    rows = own.unionByName(carried.where(~((F.col("before") == 0) & (F.col("role") == "system")))).unionByName(system)
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("before", "kind", "role", "text"))).alias("turns"),
        F.sum("kind").alias("n_new"), F.count("*").alias("n_turns"), F.sum("cost").alias("estimate"))
    pieces = F.transform("turns", lambda t: _turn(t["role"], t["text"]))
    shaped = grouped.select("conv_id", "window", "turns", "n_new", "n_turns", "estimate", pieces.alias("pieces")).select(
        "*", F.transform("pieces", F.char_length).alias("sizes"))
    starts = F.transform("sizes", lambda s, i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b))
    spans = F.filter(
        F.transform(F.arrays_zip("turns", "sizes", "starts"), lambda t: F.when(
            (t["turns"]["kind"] == 1) & (t["turns"]["role"] == "assistant"),
            F.struct(
                (t["starts"] + F.char_length(t["turns"]["role"]) + (len(START) + 1)).alias("start"),
                (t["starts"] + t["sizes"] - (len(END) + 1)).alias("end")))),
        lambda s: s.isNotNull())
    return shaped.withColumn("starts", starts).select(
        "conv_id", "window", F.array_join("pieces", "").alias("formatted"),
        (F.col("n_turns") - F.col("n_new")).alias("n_context"), "n_turns", "estimate", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, as an array of struct(role, text)."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescaped_role(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.char_length(p)), "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.locate("\n", p) + 1, F.char_length(p))).alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, read from the windows: new turns in order, and the texts under the loss mask."""
    new = F.slice(read_turns(F.col("formatted")), F.col("n_context").cast("int") + 1, F.col("n_turns").cast("int"))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = windows.select(
        "conv_id", "window", F.char_length("formatted").alias("chars"), new.alias("new"), masked.alias("masked")).select(
        "conv_id", "window", "chars", F.size("new").alias("n"),
        F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("plain"),
        F.array_join("masked", "").alias("loss"))
    whole = each.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "plain", "loss"))).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["plain"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
