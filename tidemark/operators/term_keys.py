"""Words as numbers and terms as keys of one or two words.

Words of several posts are numbered in alphabetical order; a pair with a rarer word is as rare and is in no vocabulary. So
the keys of terms are whole numbers in the order of the terms' spelling, and no term travels as a string. Frequent words,
of a bounded number, are looked up where posts are read; others meet their numbers in a join, which moves all posts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import as_table, placed

#: frequent words, of ``WIDTH`` bytes at most but for ``LONG_WORDS`` of them: 20 bytes a word in a task
HEAD_WORDS, LONG_WORDS, WIDTH = 1 << 23, 1 << 17, 16
#: words or keys that a task works on at once
DEALT = 1_000_000
#: words of a chunk of posts, but for its last post
CHUNK_WORDS = 1 << 18
#: keys of a sample for each border between groups of keys; it decides on the sizes of the groups alone
SAMPLED = 256
SECOND = 31
#: about the length of a word
WORD_BYTES = 8
_LOCAL = (1 << 33) - 1

DEALT_FIELDS = "group long, some long, entries binary"


def as_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One byte string per row; ``ends`` are the offsets of the rows in ``values``."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the byte strings of ``as_bytes`` and all their values."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // size
    some = int(ends[-1] - ends[0])
    return np.diff(ends), np.frombuffer(column.buffers()[2], kind, some, int(ends[0]) * size) if some else np.zeros(0, kind)


def by_bytes(values: np.ndarray) -> bytes:
    """First the lowest bytes of all values, then the next ones: equal bytes stand together and pack well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_bytes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys by their distances."""
    return by_bytes(np.diff(keys, prepend=0))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_bytes(data, np.int64))


def zipped(*parts: bytes) -> bytes:
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def packed(key: np.ndarray, post: np.ndarray, n: np.ndarray) -> bytes:
    """Entries in order of keys in few bytes: each key once, with the number of its posts and their distances."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    apart = np.diff(post, prepend=0)
    apart[first] = post[first]
    least = int(post.min(initial=np.iinfo(np.int32).max))
    apart[first] -= least
    several = np.diff(first, append=len(key))
    return zipped(np.array([len(key), len(first), least]).tobytes(), steps(key[first]), *[by_bytes(v.astype(np.int32)) for v in (several, apart, n)])


def unpacked_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, post and number of the entries of ``packed``."""
    raw = unzipped(data)
    some, keys, least = (int(v) for v in np.frombuffer(raw, np.int64, 3))
    cut = np.cumsum([24, 8 * keys, 4 * keys, 4 * some, 4 * some])
    several, apart, n = (from_bytes(raw[a:b], np.int32) for a, b in zip(cut[1:], cut[2:]))
    first, sums = np.cumsum(several) - several, np.cumsum(apart, dtype=np.int64)
    post = sums - np.repeat(sums[first] - apart[first], several) + least
    return np.repeat(from_steps(raw[24:cut[1]]), several), post.astype(np.int32), n


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts that are joined by spaces, and where each text's begin. An empty text has one empty word."""
    words = pc.split_pattern(texts, " ")
    return words.offsets.to_numpy(), words.values.cast(pa.string()).dictionary_encode()


def _wide(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of each word as an array of fixed width, and the number of its bytes."""
    if not len(words):
        return np.zeros(0, f"S{WIDTH}"), np.zeros(0, np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    length, wide = np.diff(ends), np.zeros((len(words), WIDTH), np.uint8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    for at in range(WIDTH):
        on = np.flatnonzero(length > at)
        wide[on, at] = data[ends[:-1][on] + at]
    return wide.view(f"S{WIDTH}").ravel(), length


def known_words(words: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """What ``codes_of`` looks words up in: short words as an array in order of codes, which is their order of bytes, and their
    codes; a dictionary has the others."""
    words = words.sort_by("code")
    names, codes = words.column("term").cast(pa.string()).combine_chunks(), words.column("code").to_numpy().astype(np.int32)
    wide, length = _wide(names)
    short = length <= WIDTH
    return wide[short], codes[short], dict(zip(names.filter(pa.array(~short)).to_pylist(), codes[~short].tolist()))


def codes_of(words: pa.Array, known: tuple[np.ndarray, np.ndarray, dict[str, int]]) -> np.ndarray:
    """The code of each word, -1 for words without one."""
    names, codes, others = known
    wide, length = _wide(words)
    found = np.full(len(words), -1, np.int32)
    if len(names):
        short = np.flatnonzero(length <= WIDTH)
        short = short[np.argsort(wide[short])]  # neighbours meet neighbours
        at = np.minimum(np.searchsorted(names, wide[short]), len(names) - 1)
        found[short] = np.where(names[at] == wide[short], codes[at], -1)
    long = np.flatnonzero(length > WIDTH)
    found[long] = [others.get(word, -1) for word in words.take(pa.array(long)).to_pylist()]
    return found


@dataclass
class Words:
    """``term, documents, code``: all words as a table, and the codes of the frequent ones; ``tail``: whether there are others."""

    table: DataFrame
    head: pa.Table
    tail: DataFrame | None = None

    @classmethod
    def of(cls, counts: DataFrame, head_words: int = HEAD_WORDS) -> Words:
        numbered = as_table(placed(counts, "words", F.col("term")).withColumnRenamed("place", "code"), "word-codes")
        long = F.octet_length("term") > WIDTH
        sizes = numbered.groupBy("documents").agg(F.count("*").alias("all"), F.count_if(long).alias("long")).toArrow().sort_by([("documents", "descending")])
        fits, fit_long = (np.cumsum(sizes.column(name).to_numpy()) <= most for name, most in (("all", head_words), ("long", LONG_WORDS)))
        if fits.all() and fit_long.all():
            return cls(numbered, numbered.select("term", "code").toArrow())

        def least(fits: np.ndarray) -> int:
            some = int(fits.sum())
            return sizes.column("documents")[some - 1].as_py() if some else sizes.column("documents")[0].as_py() + 1

        frequent = (F.col("documents") >= least(fits)) & (~long | (F.col("documents") >= least(fit_long)))
        return cls(numbered, numbered.where(frequent).select("term", "code").toArrow(), numbered.where(~frequent))

    def spelled(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``term`` for ``key``."""
        word = lambda name, code: self.table.select(F.col("term").alias(name), F.col("code").alias(code))
        coded = keys.withColumns({
            "_one": F.shiftright("key", SECOND), "_two": F.col("key").bitwiseAND(F.lit((1 << SECOND) - 1)) - 1})
        both = coded.join(word("_first", "_one"), "_one").join(word("_second", "_two"), "_two", "left")
        return both.withColumn("term", F.concat_ws(" ", "_first", "_second")).drop("key", "_one", "_two", "_first", "_second")


def coded(posts: DataFrame, words: Words, keep: Sequence[str], sliced: Callable[[Iterator], Iterator]) -> DataFrame:
    """``keep, _row, _chunk, codes`` as a table: the number of each word of ``_words``, -1 for words without one. Posts of a
    chunk have ``CHUNK_WORDS`` words, but for the last."""
    shared = posts.sparkSession.sparkContext.broadcast(known_words(words.head))
    keep = list(keep)
    tail = words.tail is not None

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before = shared.value, 0
        for batch in sliced(batches):
            ends, found = split_words(batch.column("_words"))
            first = batch.column("_row").to_numpy() >> 33 << 33
            chunk = first + (before + ends[:-1].astype(np.int64)) // CHUNK_WORDS
            before += int(ends[-1])
            codes = codes_of(found.dictionary, known)[found.indices.to_numpy()]
            columns = [*[batch.column(c) for c in [*keep, "_row"]], pa.array(chunk), as_bytes(codes, ends)]
            if tail:
                left = np.flatnonzero(codes < 0)
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))[left]
                rest = pa.StructArray.from_arrays(
                    [pa.array((left - ends[row]).astype(np.int32)), found.dictionary.take(found.indices.take(pa.array(left)))], ["at", "word"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), rest))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "_row", "_chunk", "codes", "_rest"][:len(columns)])

    fields = "".join(f"`{name}` {posts.schema[name].dataType.simpleString()}, " for name in keep) + "_row long, _chunk long, codes binary"
    kept = [F.col(f"`{c}`") for c in keep]
    numbered = posts.select(*kept, F.monotonically_increasing_id().alias("_row"), "_words")
    if not tail:
        table = as_table(numbered.mapInArrow(lookup, fields), "codes", compression="zstd")
        shared.destroy()
        return table
    table = as_table(numbered.mapInArrow(lookup, f"{fields}, _rest array<struct<at:int,word:string>>"), "frequent-codes", compression="zstd")
    shared.destroy()
    rest = table.select("_row", F.inline("_rest")).join(words.tail.select(F.col("term").alias("word"), "code"), "word").groupBy("_row").agg(
        F.collect_list(F.struct("at", F.col("code").cast("int").alias("code"))).alias("_found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, codes = unpacked(batch.column("codes"), np.int32)
            ends, codes, more = np.r_[0, np.cumsum(lengths)], codes.copy(), batch.column("_found")
            several = more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = more.flatten()
            at = np.repeat(ends[:-1], several) + flat.field("at").to_numpy(zero_copy_only=False)
            codes[at.astype(np.int64)] = flat.field("code").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keep, "_row", "_chunk"]], as_bytes(codes, ends)], [*keep, "_row", "_chunk", "codes"])

    both = table.drop("_rest").join(rest, "_row", "left").select(*kept, "_row", "_chunk", "codes", "_found")
    return as_table(both.mapInArrow(fill, fields), "codes", compression="zstd")


def post_terms(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every word and every two neighbours that have codes."""
    code = code.astype(np.int64)
    one = np.flatnonzero(code >= 0)
    two = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
    return np.concatenate([row[one], row[two]]), np.concatenate([code[one] << SECOND, (code[two] << SECOND) + code[two + 1] + 1])


class CodedPosts:
    """A table of ``coded`` with the numbers of its posts: ``ids`` has the columns to keep and ``_post``."""

    def __init__(self, codes: DataFrame, keep: Sequence[str]):
        self.codes, self.keep = codes, list(keep)
        # a post's id holds its partition and its number there; one row a partition is collected
        parts = codes.groupBy(F.shiftright("_row", 33).alias("part")).agg(
            (F.max(F.col("_row").bitwiseAND(F.lit(_LOCAL))) + 1).alias("n"), F.sum(F.octet_length("codes")).alias("bytes")).orderBy("part").collect()
        self.starts, self.posts, self.words = {}, 0, 0
        for part, n, size in parts:
            self.starts[part], self.posts, self.words = self.posts, self.posts + n, self.words + size // 4
        start = F.create_map(*[F.lit(v) for pair in self.starts.items() for v in pair]) if parts else F.lit(None)
        self.ids = codes.select(*[F.col(f"`{c}`") for c in self.keep], (
            (start[F.shiftright("_row", 33)] if parts else F.lit(0)) + F.col("_row").bitwiseAND(F.lit(_LOCAL))).alias("_post"))

    def borders(self, groups: int) -> np.ndarray:
        """Keys that cut the terms into about as many groups of about as many entries."""
        step = max(1, 2 * self.words // (SAMPLED * groups))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths, codes = unpacked(batch.column("codes"), np.int32)
                yield pa.record_batch([pa.array(post_terms(np.repeat(np.arange(len(lengths)), lengths), codes)[1][::step])], names=["key"])

        keys = np.sort(self.codes.select("codes").mapInArrow(sample, "key long").toArrow().column("key").to_numpy())
        return np.unique(keys[np.arange(1, groups) * len(keys) // groups]) if len(keys) else keys

    def dealt(self, borders: np.ndarray) -> DataFrame:
        """How often each post has each of its terms, by groups of keys, packed."""
        shared = self.codes.sparkSession.sparkContext.broadcast((borders, self.starts))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0
            for batch in batches:
                lengths, codes = unpacked(batch.column("codes"), np.int32)
                number = batch.column("_row").to_numpy()
                post = np.array([shared.value[1][int(p)] for p in number >> 33], np.int64) + (number & _LOCAL)
                held.append((np.repeat(post, lengths), codes))
                size += len(codes)
                if size >= DEALT:
                    yield send(held)
                    held, size = [], 0
            if size:
                yield send(held)

        def send(held: list[tuple]) -> pa.RecordBatch:
            post, key = post_terms(*(np.concatenate(x) for x in zip(*held)))
            order = np.argsort(key, kind="stable")  # words of a post stand together, so its equal keys do, too
            post, key = post[order].astype(np.int32), key[order]
            first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(post, prepend=-1) != 0))
            n = np.diff(first, append=len(key)).astype(np.int32)
            post, key = post[first], key[first]
            cut = np.r_[0, np.searchsorted(key, shared.value[0]), len(key)]
            rows = [(g, b - a, packed(key[a:b], post[a:b], n[a:b])) for g, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["group", "some", "entries"])

        return self.codes.select("_row", "codes").mapInArrow(deal, DEALT_FIELDS)


def entries_of(blobs: Sequence[bytes], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, post and number of the ``count`` entries of a group. All entries of a post come from one blob, in order of keys."""
    found, at = (np.empty(count, np.int64), np.empty(count, np.int32), np.empty(count, np.int32)), 0
    for part in map(unpacked_entries, blobs):
        for whole, some in zip(found, part):
            whole[at:at + len(some)] = some
        at += len(part[0])
    return found
