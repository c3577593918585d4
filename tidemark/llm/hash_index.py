"""Exact duplicates by an extendible-hash index on shared files.

One scan gives every row a slim home: its id, the 64-bit key and the SHA-256 of its normalised text. Keys that two rows
have are contested; only their texts are compared.

The directory starts as one bucket of all keys. A bucket above the capacity is split by the next bit of the key, and
the directory doubles where that bucket already uses all its bits. Buckets are key ranges, and each range has an owner
task. Texts of contested keys go to their owner once for each different text, because equal bytes are aggregated where
they are read; so a text that a third of all rows have is one row a task. The owner chains the texts of a key, compares
the bytes of neighbours in a chain, and writes the chains to the files of its buckets. Rows then find their link of the
chain by key and digest.

Which texts to read again is decided by a bitmap of contested keys, whose size follows their number up to a fixed
bound; a full bitmap lets more texts through and changes no result. Links of very large groups, of which there can only
be few, are broadcast, so that no task holds all rows of a group. A key that one row has needs no entry.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays, a null id being less
than all; of rows that share that id as well, one stays; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table, work_path

#: keys in a bucket before it splits; with more than CAPACITY * MOST_BUCKETS keys, buckets hold more
CAPACITY = 16_384
MOST_BUCKETS = 1 << 14
#: bits of a key that the directory can use, so 65,536 slots at most
MOST_BITS = 16
#: bits of the bitmap for each contested key, and its largest size (32 MB)
BITS_PER_KEY = 16
MOST_BITMAP_BITS = 1 << 28
#: groups of more than this share of all rows are broadcast: so many at most
MOST_LARGE_GROUPS = 1_024


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(text: Column, bits: int = 64) -> Column:
    """The leading ``bits`` of the text's hash. Fewer than 64 make different texts share keys, which tests need."""
    hashed = F.xxhash64(text)
    return hashed if bits == 64 else F.shiftleft(F.shiftrightunsigned(hashed, 64 - bits), 64 - bits)


@dataclass
class Directory:
    """``pointers``: the bucket of each slot, a slot being the first ``depth`` bits of a key."""

    depth: int
    pointers: np.ndarray

    @property
    def n_buckets(self) -> int:
        return int(self.pointers[-1]) + 1

    def with_bucket(self, df: DataFrame) -> DataFrame:
        slots = df.sparkSession.createDataFrame(
            pa.table({"slot": np.arange(len(self.pointers), dtype=np.int64), "bucket": self.pointers.astype(np.int32)}))
        slot = F.shiftrightunsigned("key", 64 - self.depth) if self.depth else F.lit(0).cast("long")
        return df.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")


def grow(counts: np.ndarray, capacity: int) -> Directory:
    """The directory of keys with ``counts`` by their first bits, its buckets numbered in the order of their ranges."""
    bits = int(len(counts)).bit_length() - 1
    upto = np.concatenate([[0], np.cumsum(counts)])
    depth, done, todo = 0, [], [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        width = bits - local
        if local == bits or upto[(prefix + 1) << width] - upto[prefix << width] <= capacity:
            done.append((prefix << width, local))
            continue
        depth = max(depth, local + 1)  # the directory doubles if this bucket uses all its bits
        todo += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
    done.sort()
    sizes = [1 << (depth - local) for _, local in done]
    return Directory(depth, np.repeat(np.arange(len(done)), sizes))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Reads the counts of at most 2^MOST_BITS slots."""
    found = keys.groupBy(F.shiftrightunsigned("key", 64 - MOST_BITS).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << MOST_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return grow(counts, max(capacity, int(counts.sum()) // MOST_BUCKETS))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key of ``keys``, at its middle bits."""
    wanted = BITS_PER_KEY * max(keys.count(), 1)
    bits = min(max(12, int(wanted - 1).bit_length()), MOST_BITMAP_BITS.bit_length() - 1)
    at = F.shiftrightunsigned("key", 20).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _in_bitmap(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Rows whose key may be contested. Only keys go to Python."""
    import pandas as pd

    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(key: pd.Series) -> pd.Series:
        at = (key.to_numpy().view(np.uint64) >> np.uint64(20)) & np.uint64(8 * len(sent.value) - 1)
        return pd.Series((sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0)

    maybe.__annotations__ = {"key": pd.Series, "return": pd.Series}
    return df.where(F.pandas_udf(maybe, "boolean")("key"))


_CHAINS = "bucket int, key long, chain int, sha binary, text string, n long, last long"


def _chained(batches):
    """Owner: numbers the texts of a key. They come sorted by bucket and key; a chain may go over batches."""
    key, link, before = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, texts = batch.column("key").to_numpy(), batch.column("text")
        chain = np.zeros(len(keys), np.int32)
        same = np.concatenate([[key is not None and keys[0] == key], keys[1:] == keys[:-1]])
        for i in np.flatnonzero(same):
            former = before if i == 0 else texts[i - 1].as_py()
            link = (link if i == 0 else int(chain[i - 1])) + 1
            if former == texts[i].as_py():
                raise ValueError("equal texts of one key have not met")
            chain[i] = link
        key, link, before = keys[-1], int(chain[-1]), texts[-1].as_py()
        yield pa.record_batch([batch.column(c) if c != "chain" else pa.array(chain) for c in
                               ("bucket", "key", "chain", "sha", "text", "n", "last")],
                              names=["bucket", "key", "chain", "sha", "text", "n", "last"])


def write_chains(docs: DataFrame, keys: DataFrame, places: Directory, path: str, id_column: str = "doc_id",
                 text: str = "text", key_bits: int = 64) -> DataFrame:
    """The texts of contested ``keys`` as files by bucket under ``path``: (bucket, key, chain, sha, text, n, last), one
    row for each different text with its number of rows and their largest id."""
    texts = docs.select(F.col(id_column).alias("id"), normalised(F.col(text)).alias("text")).withColumn("key", key_of(F.col("text"), key_bits))
    distinct = _in_bitmap(texts, _bitmap(keys)).groupBy("key", "text").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    owners = min(places.n_buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    entries = places.with_bucket(distinct.withColumn("sha", F.unhex(F.sha2("text", 256)))).withColumn(
        "owner", F.expr(f"cast(bucket * {owners}L div {places.n_buckets} as int)"))
    owned = entries.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key", "sha").select("bucket", "key", "sha", "text", "n", "last")
    owned.mapInArrow(_chained, _CHAINS).write.partitionBy("bucket").parquet(path)
    return docs.sparkSession.read.schema(_CHAINS).parquet(path)


def duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, chain) for each row. ``chain`` is the text's place in the chain
    of its key, null for a key that one row has."""
    spark = docs.sparkSession
    norm = normalised(F.col(text))
    homes = as_table(docs.select(F.col(id_column).alias("id"), norm.alias("t")).select(
        "id", F.monotonically_increasing_id().alias("row"), key_of(F.col("t"), key_bits).alias("key"), F.unhex(F.sha2("t", 256)).alias("sha")), "index-homes")
    digests = as_table(homes.groupBy("key", "sha").agg(
        F.count("*").alias("rows"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("stays")), "index-digests")
    keys = as_table(digests.groupBy("key").agg(F.sum("rows").alias("rows")), "index-keys")
    chains = write_chains(docs, keys.where("rows > 1").select("key"), directory(keys, capacity), work_path(spark, "index-buckets"), id_column, text, key_bits)
    links = as_table(
        chains.select("key", "sha", "chain", "n", "last").join(digests.select("key", "sha", "stays"), ["key", "sha"]), "index-links")
    large = F.col("n") > homes.count() / MOST_LARGE_GROUPS
    few = F.broadcast(links.where(large))
    found = homes.join(few, ["key", "sha"]).unionByName(
        homes.join(few, ["key", "sha"], "left_anti").join(links.where(~large), ["key", "sha"], "left"))
    alone = F.col("n").isNull()
    return found.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("last")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "chain")
