"""Best-fit packing with certified bin counts.

One pass over the texts makes token ids, cuts what is longer than a sequence, and leaves a slim table of pieces.
Pieces are packed by best-fit decreasing inside partitions of bounded size. Each partition then compares its bins
with a lower bound from dual feasible functions: a partition that meets the bound cannot be packed better and is
final. The others exchange documents: the pieces in their emptiest bins are dealt out anew among them and packed
again, until all are certified, nothing improves, or ``rounds`` are used.

Defined results: a null or empty text is the end token alone; rows with a repeated or null id are packed as rows of
their own; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

CAPACITY = 1024
END_ID = 2
#: pieces per packing partition: some MB of slim rows in one task
PIECES_PER_PARTITION = 100_000
ROUNDS = 3
#: words that a worker gathers before it forgets those that it has not met since the last time
CACHED_WORDS = 300_000

_encoders: dict[tuple[str, int | None], Encoder] = {}
#: fixed value: byte-level vocabularies write visible characters of Latin-1 as they are and all other bytes from U+0100 on
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {byte: 256 + i for i, byte in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_SPACE = chr(_ALPHABET[32])


class Encoder:
    """Ids of a byte-level BPE file as little-endian 32-bit bytes.

    A text splits into pieces before any merge, and a piece always has the same ids, so the ids of frequent pieces
    are remembered. The split is written out for the characters below U+0250, where all versions of Unicode agree;
    a text with any other character goes to the tokenizer whole. A new piece goes to the tokenizer's merge model alone,
    its bytes written in the model's alphabet; with a normalizer or added words that are no control strings, which may
    stand inside a piece, it goes to the whole tokenizer.
    """

    #: fixed values: the pattern of the vocabulary, its classes written out
    SPACES = "\\t-\\r \x85\xa0"
    LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
    DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.remembered = remembered or CACHED_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        s, l, d = self.SPACES, self.LETTERS, self.DIGITS
        self.pieces = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{d}]+| ?[^{s}{l}{d}]+|[{s}]+(?![^{s}])|[{s}]+").findall
        self.other = re.compile("[^\x00-\x1b\x20-ɏ]").search
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = self.tokenizer.normalizer is None and all(token.special for token in added)
        self.merge = self.tokenizer.model.tokenize  # asking for the model copies it
        self.known = _Known(self._merged if plain else self._single, {})

    def _single(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _merged(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            written = piece.replace(" ", _SPACE)
        else:
            written = piece.encode().decode("latin-1").translate(_ALPHABET)
        return [token.id for token in self.merge(written)]

    def ids(self, text: str) -> bytes:
        if self.other(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) > self.remembered:
            self.known = _Known(self.known.ids_of_piece, dict(self.known))
        return b"".join(map(self.known.__getitem__, self.pieces(text)))


class _Known(dict):
    """Ids of the pieces seen so far; ``older`` has those seen before."""

    def __init__(self, ids_of_piece, older: dict[str, bytes]):
        self.ids_of_piece, self.older = ids_of_piece, older

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.older.get(piece) or array("I", self.ids_of_piece(piece)).tobytes()
        return ids


def encoder(path: str, remembered: int | None = None) -> Encoder:
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text",
           with_ids: bool = False, with_copy: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids and ``copy``, a number that
    the pieces of one row of ``docs`` share and no other row has. ``remembered`` words, or ``CACHED_WORDS``, are gathered by a
    worker: fewer need less memory and more time, and give the same ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (
        ", ids binary" if with_ids else "") + (", copy long" if with_copy else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered).ids
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, value, copy in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if with_copy else repeat(0)):
                ids = encode(value.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a:4 * b]
                    out.append((key, k, a, b - a, zlib.crc32(part), *([part] * with_ids), *([copy] * with_copy)))
                if len(out) >= (1_000 if with_ids else 20_000):
                    yield _batch(out, with_ids, with_copy)
                    out = []
            if out:
                yield _batch(out, with_ids, with_copy)

    number = [F.monotonically_increasing_id().alias("copy")] if with_copy else []
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), *number).mapInArrow(cut, schema)


def _batch(rows: list[tuple], with_ids: bool, with_copy: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids + [pa.int64()] * with_copy
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["copy"] * with_copy
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number per piece. Open bins wait by room left; a bit mask finds the least room that suffices."""
    bins = np.empty(len(lengths), np.int64)
    waiting: dict[int, list[int]] = defaultdict(list)
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            number = waiting[room].pop()
            if not waiting[room]:
                mask &= ~(1 << room)
        else:
            room, number, n = capacity, n, n + 1
        bins[i] = number
        if room > size:
            waiting[room - size].append(number)
            mask |= 1 << (room - size)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from three families of dual feasible functions.

    A dual feasible function maps sizes so that any set that fits into a bin still does; the mapped sum, in
    capacities, is then a lower bound. Here: the sizes themselves; for each threshold k, sizes above capacity - k as
    whole bins and those below k as nothing; and for each step count k, sizes times k + 1 rounded down.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int(counts @ size) // capacity)
    for k in np.flatnonzero(counts[:capacity // 2 + 1]):
        value = np.where(size > capacity - k, capacity, np.where(size >= k, size, 0))
        best = max(best, -(-int(counts @ value) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in units of capacity * k
        best = max(best, -(-int(counts @ value) // (capacity * k)))
    return best


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
    lengths = rows["length"].to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(rows) else np.empty(0, bool)
    base = np.where(first, ends - lengths[order], 0)
    offsets = np.empty(len(rows), np.int64)
    offsets[order] = ends - lengths[order] - np.maximum.accumulate(base)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    return rows.assign(
        bin=bins, offset=offsets, used=used[bins], n_bins=int(bins.max()) + 1 if len(bins) else 0,
        bound=lower_bound(lengths, capacity))


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """``cut`` with sequence_id and offset.

    A round packs each part. Parts above their bound give back the pieces of all bins with room; these are dealt
    into fewer parts, so that bins with room meet, and replace their old bins if they need fewer.
    """
    # numbered where they are written; token ids, if there are any, stay there until the places are known
    stored = as_table(cut.withColumn("__row", F.monotonically_increasing_id()), "pack-pieces")
    rest = stored.drop("ids")
    columns = rest.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    schema = f"{fields}, part long, bin long, offset long, used long, n_bins long, bound long"

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack(rows, capacity)

    done, before = [], None
    for step in range(rounds):
        parts = max(1, -(-rest.count() // per_partition))
        # equal rows get different numbers, so no part grows with the copies of one row
        deal = F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(parts))
        result = as_table(
            rest.withColumn("part", deal).repartition(parts, "part").groupBy("part").applyInPandas(packed, schema)
            .withColumn("step", F.lit(step)), f"pack-{step}")
        reached = result.groupBy("part").agg(F.max("n_bins").alias("bins"), F.max("bound").alias("bound")).agg(
            F.sum("bins"), F.count_if(F.col("bins") > F.col("bound"))).first()
        if before is not None and reached[0] >= before[1]:
            done[-1] = before[0]
            break
        open_ = (F.col("n_bins") > F.col("bound")) & (F.col("used") < capacity)
        if not reached[1] or parts == 1 or step == rounds - 1:
            done.append(result)
            break
        done.append(result.where(~open_))
        reopened = result.where(open_)
        before = (result, reopened.select("part", "bin").distinct().count())
        rest = reopened.select(*columns)
    whole = done[0]
    for frame in done[1:]:
        whole = whole.unionByName(frame)
    number = F.shiftleft(F.col("part"), 23).bitwiseOR(F.shiftleft("bin", 2)).bitwiseOR(F.col("step").cast("long"))
    placed = whole.withColumn("sequence_id", number).drop("part", "bin", "used", "n_bins", "bound", "step")
    if "ids" in stored.columns:
        placed = placed.join(stored.select("__row", "ids"), "__row")
    return placed.drop("__row")
