"""Prefix trie of conversations, by a skeleton of splitter paths.

A turn is a digest of role and text, a conversation the path of its turns' digests, so equal prefixes are equal leading
characters. Paths are sorted by range partitions. A trie node is a range of the sorted paths; it lies in one shard
unless a splitter stands inside its range, and then the node is a prefix of that splitter. So the trie of the splitters,
the skeleton, holds every node that two shards share. It is broadcast: a bounded number of splitters, each cut to a
bounded number of turns, which moves borders and changes no result.

A shard is read in order once, with the path of open nodes in memory. A node is complete when the next path leaves it,
and is written with the numbers of its subtree. For skeleton nodes a shard writes partial counts; they are summed by
node, so a first turn that all conversations share costs a row per shard. Sums over the skeleton itself are made on its
few nodes. Equal conversations are split over shards by their ids like any others.

What one task must hold: the digests and sizes of one conversation (40 bytes a turn), and the children of the open
nodes of its shard. The list of ids of a node is hashed while it streams; the list of a skeleton node is hashed by one
task from pieces in order, because its digest needs that.

Defined results: a null role or text is empty; null turns come first, turns that tie are ordered by their digest; rows
without conv_id belong to no conversation; c % 5 has the sign of c; an empty table has no node. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

#: characters of a turn's digest: 128 bits of SHA-256
DIGEST = 32
#: conversations in a shard, and the most shards
SHARD_ROWS = 100_000
MOST_SHARDS = 4_096
#: sampled paths per shard for the choice of splitters, and the most nodes of the skeleton
SAMPLES = 8
SKELETON_NODES = 1 << 18
#: characters in a piece of an id list
PIECE = 1 << 16
#: fixed values of the rebuilt conversations
FAMILY = 5
MOST_SHARED = 8


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each (turn, digest, bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    return turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t")
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) with prefixes of the first conversation of each family in place of own turns."""
    own = as_table(turn_paths(turns), "trie-turns")
    first = own.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    joined = own.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("first_id"), "left")
    whole = F.concat(
        F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.array_join(F.col("turns")["digest"], "").alias("path"), F.col("turns")["size"].alias("sizes"))


def _splitters(paths: DataFrame, shards: int) -> list[tuple[str, int]]:
    """Borders of ``shards`` ranges of (path, conv_id), from a sample by hash of the ids."""
    rows = paths.count()
    wanted = SAMPLES * shards
    cut = max(1, SKELETON_NODES // shards) * DIGEST
    sample = paths.select(F.substring("path", 1, cut).alias("path"), "conv_id")
    if rows > wanted:
        sample = sample.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(wanted / rows * (1 << 30)) + 1)
    found = sorted((r.path, r.conv_id) for r in sample.collect())
    return [found[i * len(found) // shards] for i in range(1, shards)] if len(found) >= shards else found


def _skeleton(splitters: list[tuple[str, int]]) -> tuple[dict[tuple[int, str], int], list[int], list[int]]:
    """Number of each node by (parent, digest), and the parents and depths by number. The root is 0; parents come first."""
    nodes: dict[tuple[int, str], int] = {}
    parents, depths = [-1], [0]
    for path, _ in splitters:
        at = 0
        for i in range(0, len(path), DIGEST):
            step = (at, path[i:i + DIGEST])
            if step not in nodes:
                nodes[step] = len(parents)
                parents.append(at)
                depths.append(depths[at] + 1)
            at = nodes[step]
    return nodes, parents, depths


#: kind 0: a whole node, 1: a part of a skeleton node, 2: a piece of a skeleton node's id list
_FOUND = ("kind int, conv_id long, depth int, parent_conv_id long, parent int, node int, n_convs long, n_children long, "
          "n_leaves long, saved long, size long, ends string, shard int, piece int")
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_TYPES = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _FOUND.split(", ")])


class _Node:
    __slots__ = ("children", "convs", "ends", "ids", "least", "leaves", "number", "piece", "saved", "size", "waiting")

    def __init__(self, number: int, size: int):
        self.number, self.size, self.least = number, size, None
        self.convs = self.children = self.leaves = self.saved = self.piece = 0
        self.ends = None  # the running digest, or for a skeleton node the characters of its list so far
        self.ids: list[str] = []  # not yet in ends, or not yet written
        self.waiting: list[tuple] = []


class _Shard:
    """Reads sorted paths and gives the rows of ``_FOUND``."""

    def __init__(self, nodes: dict[tuple[int, str], int]):
        self.nodes, self.open, self.path, self.shard, self.out = nodes, [_Node(0, 0)], "", 0, []

    def add(self, path: str, conv: int, sizes: list[int], shard: int) -> None:
        same = 0
        if path.startswith(self.path):
            same = len(self.path)
        else:
            while path[same:same + DIGEST] == self.path[same:same + DIGEST]:
                same += DIGEST
        while len(self.open) > same // DIGEST + 1:
            self.close()
        self.shard = shard
        for i in range(same, len(path), DIGEST):
            above = self.open[-1].number
            self.open.append(_Node(self.nodes.get((above, path[i:i + DIGEST]), -1) if above >= 0 else -1, sizes[i // DIGEST]))
        self.path = path
        node = self.open[-1]
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ids.append(str(conv))
        if len(node.ids) >= PIECE >> 3:
            self.flush(node)

    def flush(self, node: _Node) -> None:
        """Ids into the digest of a whole node; out as a piece for a skeleton node."""
        if not node.ids:
            return
        text = ",".join(node.ids)
        node.ids = []
        if node.number >= 0:
            self.out.append((2, None, None, None, None, node.number, None, None, None, None, None, text, self.shard, node.piece))
            node.piece += 1
        elif node.ends is None:
            node.ends = hashlib.sha256(text.encode())
        else:
            node.ends.update(f",{text}".encode())

    def close(self) -> None:
        node = self.open.pop()
        depth, whole = len(self.open), node.number < 0
        self.flush(node)
        if whole:
            node.saved += (node.convs - 1) * node.size
            node.leaves = node.leaves or 1
            for child in node.waiting:
                self.out.append((*child[:3], node.least, *child[4:]))
            ends = (node.ends or hashlib.sha256()).hexdigest()
            row = (0, node.least, depth, None, None, None, node.convs, node.children, node.leaves, node.saved, None, ends, None, None)
            above = self.open[-1]
            if above.number < 0:
                above.waiting.append(row)
            else:
                self.out.append((*row[:4], above.number, *row[5:]))
            above.children += 1
        else:
            self.out.append((1, node.least, depth, None, None, node.number, node.convs, node.children, node.leaves, node.saved, node.size, None, None, None))
        if self.open:
            above = self.open[-1]
            above.convs += node.convs
            above.leaves += node.leaves
            above.saved += node.saved
            above.least = node.least if above.least is None else min(above.least, node.least)

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types, strict=True)] if rows else
                                          [pa.array([], t) for t in _TYPES.types], schema=_TYPES)


def _local(nodes):
    def read(batches):
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or _Shard(nodes.value)
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "sizes", "shard")), strict=True):
                shard.add(*row)
                if len(shard.out) >= 4096:
                    yield shard.taken()
        if shard:
            while shard.open:
                shard.close()
                if len(shard.out) >= 4096:
                    yield shard.taken()
            yield shard.taken()
    return read


def _dealt(splitters):
    def deal(batches):
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(splitters.value, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])
    return deal


def _hashed(batches):
    """The digest of each node's id list, from pieces sorted by node and order."""
    node, running = None, None
    for batch in batches:
        done = []
        for number, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if number == node:
                running.update(f",{text}".encode())
            else:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = number, hashlib.sha256(text.encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], schema=pa.schema([("node", pa.int32()), ("ends", pa.string())]))
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.int32()), pa.array([running.hexdigest()])], names=["node", "ends"])


def _summed(parts: DataFrame, parents: list[int], depths: list[int]) -> pa.Table:
    """The skeleton's nodes: parts summed by node, then leaves and savings of skeleton nodes added to all above them."""
    sums = parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size")).toArrow()
    at = sums["node"].to_numpy()
    full = {}
    for name in sums.column_names[1:]:
        full[name] = np.zeros(len(parents), np.int64)
        full[name][at] = sums[name].to_numpy()
    above = np.array(parents)
    np.add.at(full["n_children"], above[1:], 1)
    leaves = (full["n_children"] == 0).astype(np.int64)
    saved = np.where(above >= 0, (full["n_convs"] - 1) * full["size"], 0)
    for node in range(len(parents) - 1, 0, -1):
        leaves[parents[node]] += leaves[node]
        saved[parents[node]] += saved[node]
    return pa.table({
        "node": np.arange(len(parents), dtype=np.int32), "conv_id": full["conv_id"], "depth": np.array(depths, np.int64),
        "parent_conv_id": pa.array([None if p < 0 else int(full["conv_id"][p]) for p in parents], pa.int64()),
        "n_convs": full["n_convs"], "n_children": full["n_children"], "n_leaves": full["n_leaves"] + leaves, "saved_tokens": full["saved"] + saved})


def prefix_trie(paths: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over ``paths`` (conv_id, path, sizes): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = as_table(paths, "trie-paths")
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), paths.count() // shard_rows))
    splitters = _splitters(paths, shards)
    nodes, parents, depths = _skeleton(splitters)
    context = spark.sparkContext
    sent, borders = context.broadcast(nodes), context.broadcast(splitters)
    dealt = paths.mapInArrow(_dealt(borders), "conv_id long, path string, sizes array<long>, shard int")
    found = as_table(
        dealt.repartitionById(shards, "shard").sortWithinPartitions("path", "conv_id").mapInArrow(_local(sent), _FOUND), "trie-found")
    parts = found.where("kind = 1")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    skeleton = _summed(parts, parents, depths) if not parts.isEmpty() else _TYPES.empty_table().select(["node", "conv_id"])
    if not skeleton.num_rows:
        return found.where("kind = 0").select("conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                              F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    few = spark.createDataFrame(skeleton)
    lists = found.where("kind = 2").select("node", "ends", "shard", "piece").repartition("node").sortWithinPartitions(
        "node", "shard", "piece").select("node", "ends").mapInArrow(_hashed, "node int, ends string")
    shared = few.join(lists, "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    above = F.broadcast(few.select(F.col("node").alias("parent"), F.col("conv_id").alias("above_id")))
    whole = found.where("kind = 0").withColumn("depth", F.col("depth").cast("long")).join(above, "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above_id")).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    return whole.select(*names).unionByName(shared.select(*names))
