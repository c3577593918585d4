"""Factors of terms by columns, and products with posts by terms for vocabularies that fit the head.

Terms are numbered by falling frequency. The rows of the first ``HEAD_TERMS`` terms of a factor, the head, are an array
that travels to every task, a bounded size. What comes back, X'L, is sparse: a task adds up the terms that it saw and sends
them by piece. Where the vocabulary is larger, ``term_blocks`` has the products, and the rows of all rarer terms, the tail,
are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import as_table

HEAD_TERMS = 1 << 19
PIECE = 1 << 13

_PIECES = "piece long, ids binary, rows binary"
_PIECE_SCHEMA = pa.schema([("piece", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary())])
#: the piece that carries the extra sums of a pass
_EXTRA = -1


@dataclass(frozen=True)
class Terms:
    """``size`` terms, the first ``head_terms`` (a multiple of ``piece``) of which are the head."""

    size: int
    head_terms: int = HEAD_TERMS
    piece: int = PIECE

    @property
    def head(self) -> int:
        return min(self.size, self.head_terms)

    @property
    def tail(self) -> bool:
        return self.size > self.head_terms

    def rows(self, piece: int) -> int:
        return min(self.piece, self.size - piece * self.piece)

    def split(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of ascending ids, one piece at a time."""
        piece = ids // self.piece
        edges = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(ids)]):
            yield _pieces([(int(piece[a]), (ids[a:b] - piece[a] * self.piece).astype(np.int32).tobytes(), np.ascontiguousarray(rows[a:b]).tobytes())])


class SparseRows:
    """Weighted terms of a batch of posts: ``row``, ``term`` and ``value`` of every entry, in order of rows.

    A post's terms (int64) and weights (float64) are stored as bytes, which pass from table to numpy unconverted.
    """

    def __init__(self, batch: pa.RecordBatch):
        terms, weights = batch.column("terms"), batch.column("weights")
        ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1] // 8
        first, last = int(ends[0]), int(ends[-1])
        self.rows = batch.num_rows
        self.lengths = np.diff(ends)
        self.row = np.repeat(np.arange(self.rows), self.lengths)
        self.term, self.value = np.zeros(0, np.int64), np.zeros(0)
        if last > first:
            start = int(np.frombuffer(weights.buffers()[1], np.int32)[weights.offset]) // 8
            self.term = np.frombuffer(terms.buffers()[2], np.int64, last - first, first * 8)
            self.value = np.frombuffer(weights.buffers()[2], np.float64, last - first, start * 8)

    def times(self, right: np.ndarray) -> np.ndarray:
        """X R for R of terms by columns."""
        product = np.zeros((self.rows, right.shape[1]))
        some = self.lengths > 0
        if some.any():
            starts = (np.cumsum(self.lengths) - self.lengths)[some]
            product[some] = np.add.reduceat(right[self.term] * self.value[:, None], starts, axis=0)
        return product


class Sums:
    """X'L of the posts seen so far, and the sum of the extra arrays."""

    def __init__(self, terms: int, columns: int):
        self.columns = columns
        self.head = np.zeros((columns, terms))
        self.extra: np.ndarray | float = 0.0

    def add(self, rows: SparseRows, left: np.ndarray | None, extra: np.ndarray) -> None:
        self.extra = self.extra + extra
        if left is None or not len(rows.term):
            return
        for column, values in enumerate(left.T):
            self.head[column] += np.bincount(rows.term, rows.value * values[rows.row], self.head.shape[1])

    def batches(self, terms: Terms) -> Iterator[pa.RecordBatch]:
        yield _pieces([(_EXTRA, b"", np.ravel(self.extra).astype(float).tobytes())])
        if not self.columns:
            return
        seen = np.flatnonzero(self.head.any(axis=0))
        yield from terms.split(seen, self.head.T[seen])


def _pieces(rows: Sequence[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_SCHEMA.types)], schema=_PIECE_SCHEMA)


def _added(columns: int, terms: Terms):
    """Adds up sorted pieces as a stream; a piece comes out dense, without ids."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for piece, ids, rows in zip(batch.column("piece").to_pylist(), batch.column("ids").to_pylist(), batch.column("rows").to_pylist()):
                if piece != now:
                    if now is not None:
                        yield _pieces([(now, b"", total.tobytes())])
                    now = piece
                    total = 0.0 if piece == _EXTRA else np.zeros((terms.rows(piece), columns))
                if piece == _EXTRA:
                    total = total + np.frombuffer(rows)
                else:
                    total[np.frombuffer(ids, np.int32)] += np.frombuffer(rows).reshape(-1, columns)
        if now is not None:
            yield _pieces([(now, b"", total.tobytes())])
    return add


def normal_rows(seed: int, places: np.ndarray, columns: int) -> np.ndarray:
    """Normal numbers for the rows of a factor, each made from seed, place and column alone."""
    def even(stream: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (places.astype(np.uint64)[:, None] * np.uint64(columns) + np.arange(columns, dtype=np.uint64)) * np.uint64(2) + np.uint64(stream)
            x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64)) * np.uint64(0xD1B54A32D192ED03)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float)

    return np.sqrt(-2 * np.log((even(0) + 0.5) / 2**53)) * np.cos(2 * np.pi / 2**53 * even(1))


@dataclass
class Factor:
    """Terms by columns. ``tail`` holds (piece, ids, rows): the places of the piece's terms beyond the head, and their rows, which
    are meant times ``matrix``."""

    terms: Terms
    head: np.ndarray
    tail: DataFrame | None
    matrix: np.ndarray

    @classmethod
    def random(cls, terms: Terms, columns: int, seed: int) -> Factor:
        """Normal numbers, for a vocabulary that fits the head."""
        return cls(terms, normal_rows(seed, np.arange(terms.size), columns), None, np.eye(columns))

    @property
    def columns(self) -> int:
        return self.head.shape[1]

    def times(self, matrix: np.ndarray) -> Factor:
        return Factor(self.terms, self.head @ matrix, self.tail, self.matrix @ matrix)

    def _tail_rows(self) -> Callable[[bytes], np.ndarray]:
        matrix = self.matrix
        return lambda rows: np.frombuffer(rows).reshape(-1, len(matrix)) @ matrix

    def sums(self, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``function`` over parts of the rows."""
        total = function(self.head)
        if self.tail is None:
            return total
        rows_of = self._tail_rows()

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [function(rows_of(rows)) for batch in batches for rows in batch.column("rows").to_pylist()]
            if found:
                yield pa.record_batch([pa.array([np.ravel(sum(found)).astype(float).tobytes()], pa.binary())], names=["sums"])

        for blob in self.tail.select("rows").mapInArrow(part, "sums binary").toArrow().column("sums").to_pylist():
            total = total + np.frombuffer(blob).reshape(np.shape(total))
        return total

    def map(self, function: Callable[[np.ndarray], np.ndarray]) -> Factor:
        """``function`` of every row."""
        head = function(self.head)
        if self.tail is None:
            return Factor(self.terms, head, None, np.eye(head.shape[1]))
        rows_of = self._tail_rows()

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, ids, rows in zip(*[c.to_pylist() for c in batch.columns]):
                    yield _pieces([(piece, ids, np.ascontiguousarray(function(rows_of(rows)), float).tobytes())])

        changed = self.tail.select("piece", "ids", "rows").mapInArrow(change, _PIECES)
        return Factor(self.terms, head, as_table(changed, "factor"), np.eye(head.shape[1]))

    def dot(self, other: Factor) -> np.ndarray:
        """F' G over all terms."""
        total = self.head.T @ other.head
        if self.tail is None:
            return total
        mine, its = self._tail_rows(), other._tail_rows()

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [mine(a).T @ its(b) for batch in batches
                     for a, b in zip(batch.column("rows").to_pylist(), batch.column("others").to_pylist())]
            if found:
                yield pa.record_batch([pa.array([sum(found).tobytes()], pa.binary())], names=["sums"])

        both = self.tail.select("piece", "rows").join(other.tail.select("piece", F.col("rows").alias("others")), "piece")
        for blob in both.select("rows", "others").mapInArrow(part, "sums binary").toArrow().column("sums").to_pylist():
            total = total + np.frombuffer(blob).reshape(total.shape)
        return total

    def long(self) -> DataFrame:
        """(place, loadings) of the tail terms."""
        rows_of = self._tail_rows()

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("rows").to_pylist()):
                    yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64)), lists(rows_of(blob))], names=["place", "loadings"])

        return self.tail.select("ids", "rows").mapInArrow(rows, "place long, loadings array<double>")


def lists(matrix: np.ndarray) -> pa.ListArray:
    """One list per row."""
    return pa.ListArray.from_arrays(
        pa.array((np.arange(len(matrix) + 1) * matrix.shape[1]).astype(np.int32)), pa.array(np.ravel(matrix)))


@dataclass
class Matrix:
    """Posts by terms of the head: ``x`` holds (keep, terms, weights)."""

    x: DataFrame
    keep: list[str]

    def rows(self, factor: Factor, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """``keep`` and ``weights``, the ``function`` of X F by row."""
        keep, shared = self.keep, self._shared(factor)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name) for name in keep], lists(function(SparseRows(batch).times(shared.value)))], [*keep, "weights"])

        fields = "".join(f"`{name}` {self.x.schema[name].dataType.simpleString()}, " for name in keep)
        return self.x.select(*[F.col(f"`{c}`") for c in keep], "terms", "weights").mapInArrow(solve, f"{fields}weights array<double>")

    def _shared(self, factor: Factor):
        return self.x.sparkSession.sparkContext.broadcast(np.ascontiguousarray(factor.head))

    def product(self, factor: Factor, left: Callable[[np.ndarray, SparseRows], tuple[np.ndarray | None, np.ndarray]],
                columns: int) -> tuple[Factor, np.ndarray]:
        """X'L as a factor of ``columns`` columns, and the sum of the extras, where ``left`` gives L and extras from X F."""
        terms, shared = factor.terms, self._shared(factor)

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = Sums(terms.size, columns)
            for batch in batches:
                if batch.num_rows:
                    rows = SparseRows(batch)
                    total.add(rows, *left(rows.times(shared.value), rows))
            yield from total.batches(terms)

        sent = self.x.select("terms", "weights").mapInArrow(passed, _PIECES)
        added = sent.repartition("piece").sortWithinPartitions("piece").mapInArrow(_added(columns, terms), _PIECES)
        head, extra = np.zeros((len(factor.head), columns)), np.zeros(0)
        table = added.select("piece", "rows").toArrow()
        for piece, rows in zip(table.column("piece").to_pylist(), table.column("rows").to_pylist()):
            if piece == _EXTRA:
                extra = np.frombuffer(rows)
            else:
                head[piece * terms.piece:(piece + 1) * terms.piece] = np.frombuffer(rows).reshape(-1, columns)
        return Factor(terms, head, None, np.eye(columns)), extra
