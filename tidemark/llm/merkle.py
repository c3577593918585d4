"""Merkle manifest of a dataset, with a proof for every row found by pointer jumping.

A leaf is the hash of a row's fields. Leaves of a group (a language) stand in the order of their ids; runs of eight
neighbours become their hash until one node, the subroot, is left. Subroots are folded likewise into the root.

A proof is the chain of segments from a leaf to the root: at each level the siblings left and right of the path. Inner
nodes first hold the segment towards their parent. Each round joins the node table with itself on the ancestor that a
node points at, so the distance doubles and the segments are put end to end; a tree of d levels takes log2(d) rounds.
Leaves take no part in that: the eight leaves of a run share all segments but their own, stand in one row, and meet
the chain of their run once, at the end. Only ancestors far enough up are joined, a level has an eighth of the one
below, and a side is broadcast only after it has been counted.

Rows are numbered by a range sort, so a group may hold any share of them. Texts are read once, everything after works
on digests.

Defined results: a null field is hashed as ``-``; null ids come first, null groups are one group, first as well; equal
ids are ordered by their leaf, equal rows are leaves of their own; a group with one row has its leaf as subroot; one
group's subroot is the root; an empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.storage import as_table

ARITY = 8
#: fixed values: the fields of a leaf, in their order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: ancestors of a join that are broadcast: a row holds at most 14 levels of 7 digests, about 7 KB
BROADCAST_ANCESTORS = 4_096
BROADCAST_GROUPS = 10_000
#: the tree of the subroots
TOP = -1


@dataclass
class Manifest:
    """``runs``: (tree, idx, width, n, leaves), eight leaves a row; ``nodes``: (tree, level, idx, left, right, to, subroot)
    for inner nodes, ``to`` being the parent and ``subroot`` the digest of a group's last node, null for others;
    ``steps`` is the longest way from a run to the root."""

    runs: DataFrame
    nodes: DataFrame
    root: str | None
    steps: int


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(*(encoded(f) for f in fields))


def placed(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """``df`` as a table with ``place``, its number in the order. One count per sorted partition goes through one task."""
    parts = as_table(df.orderBy(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), label)
    counts = parts.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    return parts.join(F.broadcast(before), "part").withColumn("place", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _width(n: Column) -> Column:
    return F.ceil(n / ARITY).cast("long")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _around(kids: Column, at: Column) -> tuple[Column, Column]:
    """The digests before and after one of the run, each as one string."""
    return _joined(F.slice(kids, F.lit(1), at)), _joined(F.slice(kids, at + 2, F.lit(ARITY)))


def _folded(nodes: DataFrame) -> DataFrame:
    """(tree, idx, width, kids, digest) of the runs of ``nodes`` (tree, idx, width, digest)."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"]
    return nodes.groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx"), _width(F.col("width")).alias("width")).agg(kids.alias("kids")).withColumn(
        "digest", digest(_joined(F.col("kids"))))


def _steps(runs: DataFrame, level: int) -> DataFrame:
    """For each child of ``runs``, which stand at ``level``: which one it is, the digests around it, its parent."""
    child = runs.select("tree", F.col("idx").alias("up"), "kids", F.posexplode("kids").alias("at", "_"))
    left, right = _around(F.col("kids"), F.col("at"))
    return child.select(
        "tree", F.lit(level - 1).alias("level"), (F.col("up") * ARITY + F.col("at")).alias("idx"), left.alias("left"), right.alias("right"),
        F.struct("tree", F.lit(level).alias("level"), F.col("up").alias("idx")).alias("to"))


def _climb(nodes: DataFrame, found: list[DataFrame]) -> tuple[DataFrame, int]:
    """Folds nodes of level 1 until each tree has one. All but these last ones go to ``found`` with their steps.
    Returns the last ones (tree, level, idx, digest) and the highest level."""
    ends, level = [], 1
    while True:
        ends.append(nodes.where("width = 1").select("tree", F.lit(level).alias("level"), "idx", "digest"))
        more = nodes.where("width > 1")
        if more.isEmpty():
            return as_table(reduce(DataFrame.union, ends), "merkle-ends"), level
        level += 1
        runs = as_table(_folded(more), f"merkle-{level}")
        found.append(_steps(runs, level).withColumn("subroot", F.lit(None).cast("string")))
        nodes = runs.select("tree", "idx", "width", "digest")


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", id_column: str = "doc_id",
          suspect: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``suspect`` is a second leaf of the row (see ``leaf_of``), null where there is none; it
    is carried to ``proofs``, which folds it instead of the leaf."""
    seen = F.lit(None).cast("string") if suspect is None else suspect
    slim = as_table(docs.select(
        F.col(id_column).alias("id"), F.col(group).alias("group"), leaf_of([F.col(f) for f in fields]).alias("leaf"), seen.alias("seen"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    ordered = placed(slim, "merkle-order", F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf", "row")
    groups = as_table(ordered.groupBy("group").agg(F.count("*").alias("n"), F.min("place").alias("start")), "merkle-groups")
    n_groups, longest = groups.agg(F.count("*"), F.max("n")).first()
    trees = placed(groups, "merkle-trees", F.col("group").asc_nulls_first()).select(F.col("group").alias("g"), "n", "start", F.col("place").alias("tree"))
    trees = F.broadcast(trees) if n_groups <= BROADCAST_GROUPS else trees
    at = F.col("place") - F.col("start")
    runs = as_table(
        ordered.join(trees, F.col("group").eqNullSafe(F.col("g")))
        .groupBy("tree", F.floor(at / ARITY).alias("idx"), _width(F.col("n")).alias("width"), F.col("n"))
        .agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "id", "leaf", "seen"))).alias("leaves")), "merkle-runs")
    if not n_groups:
        return Manifest(runs, _last(runs.select("tree", F.lit(1).alias("level"), "idx")).withColumn("subroot", F.lit(None).cast("string")), None, 0)
    alone = F.col("n") == 1
    first = runs.select("tree", "idx", "width", F.when(alone, F.col("leaves")[0]["leaf"]).otherwise(digest(_joined(F.col("leaves")["leaf"]))).alias("digest"))
    found: list[DataFrame] = []
    subroots, height = _climb(first, found)
    steps = height - 1
    if n_groups == 1:
        root = subroots.first()["digest"]
        found.append(_last(subroots).withColumn("subroot", F.col("digest")).drop("digest"))
    else:
        tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_groups).cast("long").alias("width"), "digest")
        above = as_table(_folded(tops), "merkle-top")
        into = _steps(above, 1).select(F.col("idx").alias("tree"), "left", "right", "to")
        found.append(subroots.withColumnRenamed("digest", "subroot").join(into, "tree"))
        end, height = _climb(above.select("tree", "idx", "width", "digest"), found)
        root, steps = end.first()["digest"], steps + height
        found.append(_last(end).withColumn("subroot", F.lit(None).cast("string")).drop("digest"))
    return Manifest(runs, as_table(reduce(DataFrame.unionByName, found), "merkle-nodes"), root, steps)


def _last(ends: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    none = F.lit(None)
    return ends.select("*", none.cast("string").alias("left"), none.cast("string").alias("right"),
                       none.cast("struct<tree:bigint,level:int,idx:bigint>").alias("to"))


def chains(manifest: Manifest) -> DataFrame:
    """(tree, level, idx, segments, subroot): for each inner node the segments up to the root, found by pointer jumping."""
    here = F.array(F.struct("left", "right"))
    known = manifest.nodes.select(
        "tree", "level", "idx", "to", F.when(F.col("to").isNull(), F.slice(here, 1, 0)).otherwise(here).alias("segments"), "subroot")
    far = 1
    while far < manifest.steps:
        ancestors = known.where((F.col("tree") == TOP) | (F.col("level") > far)).select(
            F.struct("tree", "level", "idx").alias("id"), F.col("to").alias("next"), F.col("segments").alias("more"), F.col("subroot").alias("above"))
        few = ancestors.count() <= BROADCAST_ANCESTORS
        known = as_table(known.join(F.broadcast(ancestors) if few else ancestors, F.col("to") == F.col("id"), "left").select(
            "tree", "level", "idx", F.col("next").alias("to"),
            F.when(F.col("id").isNull(), F.col("segments")).otherwise(F.concat("segments", "more")).alias("segments"),
            F.coalesce("subroot", "above").alias("subroot")), "merkle-chains")
        far *= 2
    return known.drop("to")


def proofs(manifest: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, segments, folded_root): ``segments`` from the leaf to the root, each (left, right);
    ``folded_root`` is what they make of the suspect leaf, or of the leaf where there is none."""
    chain = chains(manifest).where((F.col("level") == 1) & (F.col("tree") != TOP)).select("tree", "idx", "segments", "subroot")
    rows = manifest.runs.join(chain, ["tree", "idx"]).select(
        "n", "segments", "subroot", F.col("leaves")["leaf"].alias("kids"), F.posexplode("leaves").alias("at", "own"))
    left, right = _around(F.col("kids"), F.col("at"))
    own = F.array(F.struct(left.alias("left"), right.alias("right")))
    whole = rows.select(
        F.col("own.id").alias("id"), F.col("own.leaf").alias("leaf"), F.coalesce("own.seen", "own.leaf").alias("start"), "subroot",
        F.when(F.col("n") == 1, F.col("segments")).otherwise(F.concat(own, "segments")).alias("segments"))
    return whole.select(
        "id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "segments", folded(F.col("start"), F.col("segments")).alias("folded_root"))


def folded(start: Column, segments: Column) -> Column:
    """The root that a leaf and its segments give."""
    return F.aggregate(segments, start, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(segments: Column) -> Column:
    """One hash of all siblings, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampering_report(docs: DataFrame, every: int = 3) -> DataFrame:
    """Proofs of all rows, checked against rows of which some have their text lower-cased: those whose id's crc32 is a
    multiple of ``every``."""
    changed = leaf_of([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    suspect = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, changed)
    found = proofs(build(docs, suspect=suspect))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("segments")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
