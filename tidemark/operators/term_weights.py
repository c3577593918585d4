"""TF-IDF weights in long form.

Posts are dealt into chunks of a bounded number of words. A chunk sends each of its terms once, as a packed key with the
number of its posts, to the groups of terms; a group adds up and sends back the numbers of posts in the order of the keys,
so that no key, post or spelling travels back. A frequent term comes once a chunk, however many posts have it. The chunk
then weighs its posts and spells its terms by its own words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .term_keys import SECOND, CodedPosts, by_bytes, from_bytes, from_steps, post_terms, split_words, steps, unpacked

#: about so many keys of chunks meet in a group
GROUP_KEYS = 500_000

_SENT = pa.schema([("group", pa.int64()), ("chunk", pa.int64()), ("key", pa.binary()), ("n", pa.binary())])
_BACK = pa.schema([("_chunk", pa.int64()), ("group", pa.int64()), ("documents", pa.binary())])


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of packed codes; and row, distinct key and number of each entry, by row."""
    lengths, codes = unpacked(column.combine_chunks(), np.int32)
    row, key = post_terms(np.repeat(np.arange(len(lengths)), lengths), codes)
    keys, which = np.unique(key, return_inverse=True)
    some = max(len(keys), 1)
    entries, n = np.unique(row * some + which, return_counts=True)
    return keys, entries // some, entries % some, n


def _documents(posts: CodedPosts, min_documents: int, most: float) -> DataFrame:
    """``_chunk, group, documents``: the posts of each key that a chunk has, 0 for too rare and too common terms."""
    spark = posts.codes.sparkSession
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-2 * posts.words // GROUP_KEYS))
    shared = spark.sparkContext.broadcast(posts.borders(groups))

    def send(key, table):
        keys, _, which, _ = _entries(table.column("codes"))
        n = np.bincount(which, minlength=len(keys)).astype(np.int32)
        cut = np.r_[0, np.searchsorted(keys, shared.value), len(keys)]
        rows = [(g, key[0].as_py(), steps(keys[a:b]), by_bytes(n[a:b])) for g, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_SENT)], schema=_SENT)

    def add(key, table):
        keys = [from_steps(x) for x in table.column("key").to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        names, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([from_bytes(x, np.int32) for x in table.column("n").to_pylist()])
        documents = np.bincount(which, n, len(names)).astype(np.int64)
        documents[(documents < min_documents) | (documents > most)] = 0
        found = documents.astype(np.int32)[which]
        back = pa.array([by_bytes(found[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
        return pa.Table.from_arrays([table.column("chunk"), table.column("group"), back], schema=_BACK)

    sent = posts.codes.select("_chunk", "codes").groupBy("_chunk").applyInArrow(send, "group long, chunk long, key binary, n binary")
    return sent.groupBy("group").applyInArrow(add, "_chunk long, group long, documents binary")


def weights(posts: CodedPosts, keep: Sequence[str], spelled: str, min_documents: int, max_share: float) -> DataFrame:
    """``keep, term, weight`` of unit length per post; the column ``spelled`` has the words that were coded."""
    keep, total = list(keep), posts.posts
    fields = "".join(f"`{name}` {posts.codes.schema[name].dataType.simpleString()}, " for name in keep) + "term string, weight double"

    def weigh(left, right):
        keys, row, which, n = _entries(left.column("codes"))
        by_group = right.sort_by("group").column("documents").to_pylist()
        documents = np.concatenate([np.zeros(0, np.int32), *[from_bytes(x, np.int32) for x in by_group]])
        good = documents[which] > 0
        row, which, n = row[good], which[good], n[good]
        value = (1 + np.log(n)) * (np.log((1 + total) / (1 + documents[which])) + 1)
        value /= np.sqrt(np.bincount(row, value * value, left.num_rows))[row]
        place = np.cumsum(documents > 0) - 1
        terms = _spelled(keys[documents > 0], left.column("codes"), left.column(spelled)).take(pa.array(place[which]))
        kept = [left.column(name).combine_chunks().take(pa.array(row)) for name in keep]
        return pa.Table.from_arrays([*kept, terms, pa.array(value)], [*keep, "term", "weight"])

    codes = posts.codes.select("_chunk", *[F.col(f"`{name}`") for name in keep], F.col(spelled), "codes")
    return codes.groupBy("_chunk").cogroup(_documents(posts, min_documents, max_share * total).groupBy("_chunk")).applyInArrow(weigh, fields)


def _spelled(keys: np.ndarray, codes: pa.ChunkedArray, texts: pa.ChunkedArray) -> pa.Array:
    """The terms of keys, from the words of the posts that have them."""
    words = split_words(texts.combine_chunks())[1]
    code, at = np.unique(unpacked(codes.combine_chunks(), np.int32)[1], return_index=True)
    names = words.take(pa.array(at)).dictionary_decode()
    one, two = keys >> SECOND, (keys & ((1 << SECOND) - 1)) - 1
    first = names.take(pa.array(np.searchsorted(code, one)))
    second = names.take(pa.array(np.searchsorted(code, two), mask=two < 0))
    return pc.coalesce(pc.binary_join_element_wise(first, second, " "), first)
