"""Posts by terms, kept by terms: products for vocabularies beyond the head.

A vocabulary grows nearly as fast as its posts, and most of its terms stand in a few posts. So a factor of terms by columns
is far larger than the weights of the posts, and a pass never stores or sends one. Entries are dealt into groups of terms
once, by ranges of keys, one row a group: a group has all entries of its terms, so it counts their posts itself, and drops
the terms that are too rare or too common. A task makes the rows of a group from the posts' weights, uses them and forgets
them: what goes to the tasks are the weights (8 bytes a post and column), what comes back is one product a task, added up
by chunks of posts. Posts get unit length in the products: entries are stored as counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import as_table
from .term_factor import Factor, Terms, lists
from .term_keys import CodedPosts, Words, as_bytes, by_bytes, entries_of, from_bytes, from_steps, steps, unzipped, zipped

#: entries of a group of terms: a task of posts sends a row to each group, and rows of few entries pack badly
GROUP_ENTRIES = 1_000_000
#: posts of a chunk of a product
CHUNK = 1 << 14
_STATS = -1

Change = Callable[[np.ndarray, np.ndarray | None], np.ndarray]


@dataclass
class Derived:
    """The rows of a factor as ``change(places, X'L)``, where L, posts by columns, is ``left``; None: from places alone."""

    left: np.ndarray | None
    change: Change


def _table(names: str, *columns: Sequence) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * (len(columns) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


class TermBlocks:
    """Posts by terms as (group, keys, documents, entries): entries are packed and have the place of their term in ``keys``, the post
    and how often it has the term. Terms are numbered by falling frequency, then by key."""

    def __init__(self, coded: CodedPosts, words: Words, min_documents: int, max_share: float, head_terms: int, piece: int):
        self.coded, self.words, self.posts = coded, words, coded.posts
        self.spark = coded.codes.sparkSession
        self.tasks = self.spark.sparkContext.defaultParallelism
        self.borders = coded.borders(max(4 * self.tasks, -(-2 * coded.words // GROUP_ENTRIES)))
        self.known: tuple[Factor, DataFrame] | None = None
        most = max_share * self.posts

        def gather(key, table):
            keys, post, n = entries_of(table.column("entries").to_pylist(), pc.sum(table.column("some")).as_py())
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            documents = np.diff(first, append=len(keys))
            good = (documents >= min_documents) & (documents <= most)
            blobs = [steps(keys[first][good]), documents[good].astype(np.int32).tobytes()]
            del keys, first
            order = order[np.repeat(good, documents)]
            term = np.repeat(np.arange(good.sum(), dtype=np.int32), documents[good])
            post, n = post[order], n[order]
            order = np.argsort(post, kind="stable")  # neighbours are alike, which packs better
            blobs.append(zipped(*[by_bytes(v) for v in (term[order], np.diff(post[order], prepend=np.int32(0)), n[order])]))
            return pa.Table.from_batches([_table("group keys documents entries", [key[0].as_py()], *[[b] for b in blobs])])

        fields = "group long, keys binary, documents binary, entries binary"
        self.table = as_table(coded.dealt(self.borders).groupBy("group").applyInArrow(gather, fields), "blocks", compression="zstd")
        self._number(head_terms, piece)

    def _number(self, head_terms: int, piece: int) -> None:
        """Where the terms of each group with so many posts begin among all; a group's own are in order of keys."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, blob in zip(batch.column("group").to_pylist(), batch.column("documents").to_pylist()):
                    documents, n = np.unique(np.frombuffer(blob, np.int32), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(n), group)), pa.array(documents.astype(np.int64)), pa.array(n)], names=["group", "documents", "n"])

        found = self.table.select("group", "documents").mapInArrow(count, "group long, documents long, n long").toArrow()
        group, documents, n = (found.column(c).to_numpy() for c in ("group", "documents", "n"))
        order = np.lexsort((group, -documents))
        start = np.zeros(len(n), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        self.terms = Terms(int(n.sum()), head_terms, piece)
        order = np.lexsort((documents, group))
        edges = np.flatnonzero(np.diff(group[order], prepend=-1))
        self.starts = self.spark.sparkContext.broadcast({
            int(group[at[0]]): (documents[at], start[at]) for at in np.split(order, edges[1:]) if len(at)})

    def places(self) -> Callable[[int, bytes], np.ndarray]:
        """The places of a group's terms from their numbers of posts."""
        starts = self.starts

        def of(group: int, blob: bytes) -> np.ndarray:
            documents = np.frombuffer(blob, np.int32)
            if not len(documents):
                return np.zeros(0, np.int64)
            order = np.argsort(documents, kind="stable")
            several, first = np.unique(documents[order], return_index=True)
            rank = np.empty(len(documents), np.int64)
            rank[order] = np.arange(len(documents)) - np.repeat(first, np.diff(first, append=len(documents)))
            values, start = starts.value[group]
            return start[np.searchsorted(values, documents)] + rank

        return of

    def vocabulary(self) -> DataFrame:
        """``place, key, idf`` of all terms."""
        places, idf = self.places(), self.idf()

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, keys, documents in zip(*[c.to_pylist() for c in batch.columns]):
                    yield pa.record_batch([pa.array(places(group, documents)), pa.array(from_steps(keys)), pa.array(idf(documents))], names=["place", "key", "idf"])

        return self.table.select("group", "keys", "documents").mapInArrow(rows, "place long, key long, idf double")

    @property
    def x(self) -> DataFrame:
        """``keep, terms, weights`` of unit length, in the bytes that ``SparseRows`` reads; passes do not need it."""
        places, idf, unit = self.places(), self.idf(), self.shared_unit

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, documents, (term, post, value) in _groups(batches, idf):
                yield pa.record_batch([pa.array(post.astype(np.int64)), pa.array(places(group, documents)[term]), pa.array(value * unit.value[post])], names=["_post", "place", "value"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = pc.fill_null(pc.list_value_length(batch.column("found")), 0).to_numpy(zero_copy_only=False)
                flat, ends = batch.column("found").flatten(), np.r_[0, np.cumsum(lengths)]
                blobs = [as_bytes(flat.field(c).to_numpy(zero_copy_only=False).astype(kind), ends) for c, kind in (("place", np.int64), ("value", float))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *blobs], [*keep, "terms", "weights"])

        keep = self.coded.keep
        of_post = self.table.mapInArrow(entries, "_post long, place long, value double").groupBy("_post").agg(
            F.array_sort(F.collect_list(F.struct("place", "value"))).alias("found"))
        fields = "".join(f"`{name}` {self.coded.ids.schema[name].dataType.simpleString()}, " for name in keep)
        rows = self.coded.ids.join(of_post, "_post", "left").select(*[F.col(f"`{c}`") for c in keep], "found")
        return rows.mapInArrow(pack, f"{fields}terms binary, weights binary")

    def idf(self) -> Callable[[bytes], np.ndarray]:
        posts = self.posts
        return lambda documents: np.log((1 + posts) / (1 + np.frombuffer(documents, np.int32))) + 1

    def measure(self) -> tuple[float, float]:
        """Measures the posts; the sum of all entries of unit length, and of their squares."""
        posts, idf = self.posts, self.idf()

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _Product(2, posts, lambda _: np.zeros(1))
            for _, _, entries in _groups(batches, idf):
                total.squares(entries)
            yield from total.batches()

        table = self._added(self.table.coalesce(self.tasks).mapInArrow(task, "chunk long, rows binary")).toArrow().sort_by("chunk")
        sums = np.concatenate([np.zeros((0, 2)), *[np.frombuffer(x).reshape(-1, 2) for c, x in zip(*[table.column(c).to_pylist() for c in ("chunk", "rows")]) if c >= 0]])
        self.unit = _unit(sums[:, 1])
        self.shared_unit = self.spark.sparkContext.broadcast(self.unit)
        return float((sums[:, 0] * self.unit).sum()), float((self.unit > 0).sum())

    @staticmethod
    def _added(sent: DataFrame) -> DataFrame:
        return sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_chunks_added, "chunk long, rows binary")

    def _left(self, left: np.ndarray | None):
        """L for unit rows of X, by columns, for all tasks."""
        return None if left is None else self.spark.sparkContext.broadcast(np.ascontiguousarray((left * self.unit[:, None]).T))

    def project(self, factor: Derived, columns: int, stats: Callable[[np.ndarray], np.ndarray], product: bool = True) -> tuple[DataFrame | None, np.ndarray]:
        """X F as (chunk, rows), and the sum of ``stats`` over parts of the rows of F."""
        posts, change, places, idf, left = self.posts, factor.change, self.places(), self.idf(), self._left(factor.left)
        held = columns if product else 0

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _Product(held, posts, stats)
            for group, documents, entries in _groups(batches, idf):
                total.add(change(places(group, documents), _sums(left and left.value, entries, len(documents) // 4)), entries)
            yield from total.batches()

        sent = self.table.coalesce(self.tasks).mapInArrow(task, "chunk long, rows binary")
        added = as_table(self._added(sent), "product")
        if left:
            left.destroy()
        found = added.where(F.col("chunk") == _STATS).toArrow().column("rows").to_pylist()
        return (added.where(F.col("chunk") >= 0) if product else None), np.frombuffer(found[0])

    def left(self, product: DataFrame, columns: int, function: Callable[[np.ndarray], tuple[np.ndarray | None, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """L and the sum of the extras, where ``function`` gives L and extras from rows of a product."""
        unit = self.shared_unit

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
                    found, extra = function(_unit_rows(unit.value, chunk, np.frombuffer(rows).reshape(-1, columns)))
                    yield _table("chunk rows extra", [chunk], [b"" if found is None else np.ascontiguousarray(found).tobytes()],
                                 [np.ravel(extra).astype(float).tobytes()])

        table = product.mapInArrow(solve, "chunk long, rows binary, extra binary").toArrow().sort_by("chunk")
        extra = sum(np.frombuffer(blob) for blob in table.column("extra").to_pylist())
        flat = np.frombuffer(b"".join(table.column("rows").to_pylist()))
        return flat.reshape(self.posts, -1) if len(flat) else np.zeros((0, 0)), extra

    def factor(self, derived: Derived, matrix: np.ndarray, product: DataFrame) -> Factor:
        """The rows of ``derived`` times ``matrix`` as a factor: the head as an array, the others as a table by groups."""
        head, change, places, idf, left = self.terms.head, derived.change, self.places(), self.idf(), self._left(derived.left)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, documents, entries in _groups(batches, idf):
                at = places(group, documents)
                rows = np.ascontiguousarray(change(at, _sums(left and left.value, entries, len(at))), float)
                near = at < head
                yield _table("piece near_ids near ids rows", [group], *[[v.tobytes()] for v in (at[near], rows[near], at[~near], rows[~near])])

        made = as_table(self.table.mapInArrow(make, "piece long, near_ids binary, near binary, ids binary, rows binary"), "factor")
        if left:
            left.destroy()
        near = np.zeros((head, len(matrix)))
        found = made.select("near_ids", "near").toArrow()
        for ids, rows in zip(found.column("near_ids").to_pylist(), found.column("near").to_pylist()):
            near[np.frombuffer(ids, np.int64)] = np.frombuffer(rows).reshape(-1, len(matrix))
        result = Factor(self.terms, near @ matrix, made, matrix)
        self.known = result, product
        return result

    def rows(self, factor: Factor, function: Callable[[np.ndarray], np.ndarray], new: CodedPosts | None = None) -> DataFrame:
        """``keep`` and ``weights``, the ``function`` of X F by row, for the posts of the fit or for ``new`` ones."""
        matrix, width, unit = factor.matrix, len(factor.matrix), self.shared_unit
        posts, fresh = new or self.coded, new is not None
        product = self._times(factor, new) if fresh else self.known[1]

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
                    rows = np.frombuffer(blob).reshape(-1, width + fresh)
                    rows = rows[:, :width] * _unit(rows[:, width])[:, None] if fresh else _unit_rows(unit.value, chunk, rows)
                    found = function(rows @ matrix)
                    yield pa.record_batch([pa.array(np.arange(len(found)) + chunk * CHUNK), lists(found)], names=["_post", "weights"])

        solved = product.mapInArrow(solve, "_post long, weights array<double>")
        return posts.ids.join(solved, "_post").select(*[F.col(f"`{c}`") for c in posts.keep], "weights")

    def _times(self, factor: Factor, new: CodedPosts) -> DataFrame:
        """X F without its matrix, and the squared lengths of X's rows, for new posts as (chunk, rows)."""
        width, posts, head, places, idf = len(factor.matrix), new.posts, self.terms.head, self.places(), self.idf()

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _Product(width + 1, posts, lambda rows: np.zeros(1))
            for group, (keys, documents, near, rows), entries in _meetings(batches):
                keys = from_steps(keys)
                if not len(keys):
                    continue
                whole, some = np.empty((len(keys), width)), places(group, documents) < head
                whole[some], whole[~some] = (np.frombuffer(x).reshape(-1, width) for x in (near, rows))
                counts, blobs = zip(*entries)
                key, post, n = entries_of(blobs, sum(counts))
                term = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = np.flatnonzero(keys[term] == key)
                on = on[np.argsort(post[on], kind="stable")]
                term, post, n = term[on], post[on], n[on]
                total.add(whole, (term, post, _values(n, idf(documents), term)), square=True)
            yield from total.batches()

        sent = self.meeting(factor, new).coalesce(self.tasks).mapInArrow(task, "chunk long, rows binary")
        return as_table(self._added(sent), "product").where(F.col("chunk") >= 0)

    def meeting(self, factor: Factor, new: CodedPosts) -> DataFrame:
        """The groups of new posts' terms with the terms of the fit and the rows of the factor, one group after the other. All
        is dealt once, as it is: a join would send the entries again, unpacked."""
        none = F.lit(None).cast("binary")
        zero = F.lit(0).cast("long")
        terms = self.table.select("group", F.lit(0).alias("kind"), zero.alias("some"), F.col("keys").alias("one"), F.col("documents").alias("two"))
        rows = factor.tail.select(F.col("piece").alias("group"), F.lit(1), zero, "near", "rows")
        entries = new.dealt(self.borders).select("group", F.lit(2), "some", "entries", none)
        return terms.union(rows).union(entries).repartition("group").sortWithinPartitions("group", "kind")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, list]]:
    """Group, (keys, documents, near, rows) and packed entries of each group of ``meeting`` that has entries."""
    now, known, entries = None, (), []
    for batch in batches:
        for group, kind, some, one, two in zip(*[batch.column(c).to_pylist() for c in ("group", "kind", "some", "one", "two")]):
            if group != now:
                if len(known) == 4 and entries:
                    yield now, known, entries
                now, known, entries = group, (), []
            if kind < 2:
                known += one, two
            else:
                entries.append((some, one))
    if len(known) == 4 and entries:
        yield now, known, entries


def _unit(squares: np.ndarray) -> np.ndarray:
    return np.where(squares > 0, 1 / np.sqrt(np.where(squares > 0, squares, 1)), 0)


def _unit_rows(unit: np.ndarray, chunk: int, rows: np.ndarray) -> np.ndarray:
    return rows * unit[chunk * CHUNK:chunk * CHUNK + len(rows), None]


def _groups(batches: Iterator[pa.RecordBatch], idf: Callable[[bytes], np.ndarray]) -> Iterator[tuple[int, bytes, tuple[np.ndarray, ...]]]:
    """Each group with its numbers of posts and its terms, posts and values."""
    for batch in batches:
        for at, group in enumerate(batch.column("group").to_pylist()):
            raw = unzipped(batch.column("entries")[at].as_py())
            term, post, n = (from_bytes(raw[a:a + len(raw) // 3], np.int32) for a in (0, len(raw) // 3, 2 * (len(raw) // 3)))
            post = np.cumsum(post, dtype=np.int32)
            del raw
            documents = batch.column("documents")[at].as_py()
            yield group, documents, (term, post, _values(n, idf(documents), term))


def _values(n: np.ndarray, idf: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Entries before their posts get unit length, in one array."""
    value = np.log(n)
    value += 1
    value *= idf[term]
    return value


def _times_at(value: np.ndarray, column: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = column[at]
    found *= value
    return found


def _sums(left: np.ndarray | None, entries: tuple[np.ndarray, ...], terms: int) -> np.ndarray | None:
    """X'L of a group, for L by columns."""
    term, post, value = entries
    return None if left is None else np.stack([np.bincount(term, _times_at(value, column, post), terms) for column in left], axis=1)


class _Product:
    """X F of the groups that a task has seen, and the sum of the stats."""

    def __init__(self, columns: int, posts: int, stats: Callable[[np.ndarray], np.ndarray]):
        self.z, self.posts, self.stats, self.total = np.zeros((columns, posts)), posts, stats, 0.0

    def add(self, rows: np.ndarray, entries: tuple[np.ndarray, ...], square: bool = False) -> None:
        """``square``: the last column holds the squared lengths."""
        term, post, value = entries
        self.total = self.total + np.ravel(self.stats(rows))
        if len(self.z) and len(post):  # entries are in order of posts
            first = np.flatnonzero(np.diff(post, prepend=-1))
            for column in range(len(self.z) - square):
                self._put(column, post[first], np.add.reduceat(_times_at(value, np.ascontiguousarray(rows[:, column]), term), first))
            if square:
                self._put(-1, post[first], np.add.reduceat(value**2, first))

    def squares(self, entries: tuple[np.ndarray, ...]) -> None:
        """The sums of values and of their squares."""
        self.add(np.ones((int(entries[0].max(initial=0)) + 1, 1)), entries, square=True)

    def _put(self, column: int, posts: np.ndarray, sums: np.ndarray) -> None:
        self.z[column][posts] += sums

    def batches(self) -> Iterator[pa.RecordBatch]:
        if np.ndim(self.total):
            yield _table("chunk rows", [_STATS], [self.total.astype(float).tobytes()])
        for a in range(0, self.posts if len(self.z) else 0, CHUNK):
            yield _table("chunk rows", [a // CHUNK], [np.ascontiguousarray(self.z[:, a:a + CHUNK].T).tobytes()])


def _chunks_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sorted chunks as a stream."""
    now, total = None, None
    for batch in batches:
        for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
            if chunk != now:
                if now is not None:
                    yield _table("chunk rows", [now], [total.tobytes()])
                now, total = chunk, 0.0
            total = total + np.frombuffer(rows)
    if now is not None:
        yield _table("chunk rows", [now], [total.tobytes()])
