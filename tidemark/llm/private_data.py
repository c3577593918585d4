"""Personal data: base patterns, and identifiers found by bootstrapped contexts. DataFrame functions only.

Base entities are what four fixed patterns match (see ``BASE``). They are the seeds of the bootstrap: a token that
holds a digit or an at sign is an instance, the words before it are patterns, and both form a graph. Pattern
confidence is the mean score of its instances, damped by its support; the score of an instance is 1 for a seed, else
the best confidence among its patterns; Spark repeats the two sums ``ROUNDS`` times. Patterns that end above
``CONFIDENCE`` and stand before ``SUPPORT`` different seeds mark the identifiers of the same shape class behind them.

Texts are read by expressions inside the scan. Only instances with their contexts are exchanged, and they are summed
before; a pattern or instance that a third of all texts hold is one row per task.

Positions without user functions: the pieces between matches and the matches alternate, so a start is the sum of the
lengths before it. Patterns are written with possessive loops and tests for the start of a run, which changes no
match and makes every scan linear.

Defined results: a null text is empty; rows with a null id, or with an id and text that repeat, are rows of their
own with equal spans; an empty table gives an empty table; a column of the input with the name of an output column
is replaced in ``masked``, and dropped elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

from .names import quoted
from .quality import let

#: fixed values: the base patterns, in the order in which kinds are listed
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone", "id")
#: tokens with a digit or an at sign
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: white space at most, and how much text before an instance is context
CONTEXT_CHARS = 160
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.75, 3
#: found identifiers, patterns or instances that may be sent to all tasks
MAX_SENT = 500_000
#: tasks that share the edges of one pattern or instance where its facts are too many to be sent
SALTS = 32


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: kind -> pattern, test of a match
BASE: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda m: F.lit(True)),
    "ip": (IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": (CARD, lambda m: F.char_length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))),
    "phone": (PHONE, lambda m: F.char_length(_digits(m)).between(8, 15)),
}
_HINT = {"email": "@", "phone": "+"}
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def placed(text: Column, pattern: str) -> Column:
    """Matches of a pattern as struct(start, match, before): code points, and the text back to the match before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,match:string,before:string>>").alias("found"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["g"])
        one = F.array(F.struct(begin.alias("start"), x["m"].alias("match"), x["g"].alias("before")))
        return F.struct(
            (begin + F.char_length(x["m"])).alias("at"),
            F.coalesce(F.concat(state["found"], one), one).alias("found"))

    return F.aggregate(both, start, add)["found"]


def base_spans(text: Column) -> Column:
    """All base spans, ordered by kind and start."""
    return F.concat(*(_spans_of(text, number, kind) for number, kind in enumerate(BASE)))


def _spans_of(text: Column, number: int, kind: str) -> Column:
    pattern, test = BASE[kind]
    found = F.transform(
        F.filter(placed(text, pattern), lambda x: test(x["match"])),
        lambda x: F.struct(
            F.lit(number).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["match"])).alias("end")))
    possible = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike("[0-9]")
    return F.coalesce(F.when(possible, found), F.array().cast(_SPANS))


def instances(docs: DataFrame) -> DataFrame:
    """row, start, end, instance, seed, shape, patterns: one row per instance in ``docs`` (row, text, base)."""
    some = docs.where(F.col("text").rlike("[0-9@]")).select("row", "base", placed(F.col("text"), INSTANCE).alias("found"))
    each = some.select("row", "base", F.explode("found").alias("x")).select(
        "row", "base", F.col("x.start").alias("at"), F.col("x.match").alias("token"),
        F.substring(F.col("x.before"), F.greatest(F.lit(1), F.char_length("x.before") - (CONTEXT_CHARS - 1)), F.lit(CONTEXT_CHARS)).alias("before"))
    # what stands in quotes, brackets or before punctuation is the instance; name= or name: is context
    cue = F.regexp_extract("token", r"^[^0-9A-Za-z]*([A-Za-z_]+[=:])", 1)
    lead = F.char_length(F.regexp_extract("token", r"^([^0-9A-Za-z@+]*(?:[A-Za-z_]+[=:])?[^0-9A-Za-z@+]*)", 1))
    core = F.regexp_replace(F.substring(F.col("token"), lead + 1, F.char_length("token")), r"[^0-9A-Za-z]+$", "")
    cut = each.select("row", "base", (F.col("at") + lead).alias("start"), core.alias("instance"), cue.alias("cue"), F.lower("before").alias("before"))
    words = F.filter(F.split("before", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shaped = cut.where("instance <> ''").select(
        "*", (F.col("start") + F.char_length("instance")).alias("end"), words.alias("words"),
        F.regexp_replace(F.regexp_replace("instance", "[0-9]+", "9"), "[A-Za-z]+", "a").alias("shape"))
    n = F.size("words")
    patterns = F.array_compact(F.array(
        F.when(F.col("cue") != "", F.concat(F.lit("in "), F.lower("cue"))),
        F.when((F.col("cue") == "") & (n >= 1), F.concat(F.lit("1 "), F.get("words", n - 1))),
        F.when((F.col("cue") == "") & (n >= 2), F.concat(F.lit("2 "), F.get("words", n - 2), F.lit(" "), F.get("words", n - 1)))))
    overlaps = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    return shaped.select("row", "start", "end", "instance", overlaps.alias("seed"), "shape", patterns.alias("patterns"))


def _told(edges: DataFrame, facts: DataFrame, key: str, label: str) -> DataFrame:
    """``edges`` with what ``facts`` (one row per ``key``) says of theirs. Few facts are broadcast after a count; more of
    them meet their edges in ``SALTS`` tasks a key, because one pattern or instance may have a third of all edges."""
    facts = as_table(facts, label)
    if facts.count() <= MAX_SENT:
        return edges.join(F.broadcast(facts), key)
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.withColumn("__salt", F.pmod(F.xxhash64("pattern", "instance"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "__salt"]).drop("__salt")


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, confidence of the patterns that mark identifiers, from the pattern-instance graph of ``found``."""
    graph = as_table(
        found.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")),
        "private-graph")
    seeds = graph.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("n"))
    scored = graph.select("pattern", "instance", F.col("seed").cast("double").alias("score"), "seed")
    patterns = None
    for step in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(0.5))).alias("confidence"))
        best = _told(scored, patterns, "pattern", f"private-patterns-{step}").groupBy("instance").agg(F.max("confidence").alias("best"))
        scored = as_table(_told(graph, best, "instance", f"private-best-{step}").select(
            "pattern", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("best")).alias("score"), "seed"), f"private-scores-{step}")
    return patterns.join(seeds, "pattern").where((F.col("confidence") >= confidence) & (F.col("seeds") >= support)).select("pattern", "confidence")


def unseen(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """row, added: the spans that confident patterns discover. An identifier has four digits or more, six characters
    or more, and touches no base span."""
    likely = found.where(~F.col("seed")).where(
        (F.char_length("instance") >= 6) & (F.char_length(_digits(F.col("instance"))) >= 4))
    marked = likely.select("row", "start", "end", F.explode("patterns").alias("pattern")).join(patterns.select("pattern"), "pattern", "left_semi")
    return marked.select("row", "start", "end").distinct().groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.lit(len(KINDS) - 1).alias("kind"), "start", "end"))).alias("added"))


def _with_base(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """row names what a row says: rows of one id and one text have the same spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select("*", F.struct(F.col(id_column).cast("long").alias("id"), F.xxhash64(whole).alias("hash")).alias("row"), whole.alias("__text")).select(
        "*", base_spans(F.col("__text")).alias("base"))


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, base and added spans of every row; the text too if asked for."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    whole = _with_base(slim, "doc_id", "text")
    found = as_table(instances(whole.select("row", F.col("__text").alias("text"), "base")), "private-instances")
    added = as_table(unseen(found, confident_patterns(found)), "private-added")
    few = added.count() <= MAX_SENT
    columns = ["doc_id", "base", *(["text"] if keep_text else [])]
    rows = whole.select("row", *columns)
    named = (F.broadcast(added) if few else added).withColumnRenamed("row", "__row")
    same = F.col("row").getField("id").eqNullSafe(F.col("__row").getField("id")) & (F.col("row").getField("hash") == F.col("__row").getField("hash"))
    return rows.join(named, same, "left").select(*columns, F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``find``."""

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"))


def masked(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets. Of overlapping spans the first
    names the whole stretch."""
    named_as = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c.lower() not in (id_column.lower(), text.lower())}
    others = F.struct(*(F.col(quoted(c)).alias(n) for c, n in named_as.items())) if named_as else F.lit(None).cast("struct<x:int>")
    packed = docs.select(F.col(quoted(id_column)).alias("doc_id"), F.col(quoted(text)).alias("text"), others.alias("__others"))
    whole = _with_base(packed, "doc_id", "text")
    found = as_table(instances(whole.select("row", F.col("__text").alias("text"), "base")), "private-instances")
    added = as_table(unseen(found, confident_patterns(found)), "private-added")
    named = (F.broadcast(added) if added.count() <= MAX_SENT else added).withColumnRenamed("row", "__row")
    same = F.col("row").getField("id").eqNullSafe(F.col("__row").getField("id")) & (F.col("row").getField("hash") == F.col("__row").getField("hash"))
    joined = whole.join(named, same, "left")
    spans = F.sort_array(F.transform(
        F.concat("base", F.coalesce("added", F.array().cast(_SPANS))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        plain = F.concat(
            state["parts"], F.array(F.substring(F.col("__text"), state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"])))
        return F.when(s["start"] < state["at"], F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), plain.alias("parts")))

    done = let(F.aggregate(spans, first, add), lambda r: F.concat(
        F.array_join(r["parts"], ""), F.substring(F.col("__text"), r["at"] + 1, F.char_length("__text"))))
    result = F.when(F.size(spans) > 0, done).otherwise(F.col("text"))
    replaced = joined.select("doc_id", "__others", result.alias("__new"))
    shown = {id_column.lower(): F.col("doc_id"), text.lower(): F.col("__new")}
    return replaced.select(*(shown[c.lower()].alias(c) if c.lower() in shown else F.col("__others").getField(named_as[c]).alias(c) for c in docs.columns))
