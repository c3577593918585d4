"""Near duplicates by exact Jaccard similarity of word shingles, with set relations to skip work.

A text's set holds 64-bit hashes of its distinct shingles of ``width`` words. Two texts link when
``100 * intersection >= percent * union``. The join runs over different sets, not texts: equal sets are one class from
the start, and carry the least id of their texts.

1. Counts: shingles are counted over the whole corpus in sorted, gap-coded pieces. Frequent ones go to the end of the
   order of every set, so a passage that many texts share is outside the prefixes of texts that hold more than it.
2. Index: each set posts the head of its order (its prefix) to lists by shingle. Linked sets share a posting at their
   first common shingle. A list is sorted by set size, so the sets that can link with one of its sets are a run;
   positions bound the overlap that is left, and what lies outside run and bound is skipped as a block.
3. Hubs: the ``HUBS`` first sets of a list by hash are its hubs; lists of up to ``HUBS`` + 1 sets hold no other pairs. In
   rounds, each set meets one hub, the one with which it shares most lists, and the components are contracted; the next
   round offers another hub only where set and hub are still apart. So a round looks at one pair a set, however large
   its group and however many lists it stands in. What ``ROUNDS`` rounds leave apart is met after them: pairs of lists
   without other pairs by themselves, all others with step 4.
4. Derived answers: a set that is joined to its most similar hub takes over that hub's component, and no other pair of
   the component is looked at. What is left are lists with sets of different components; there the remaining pairs are
   met in blocks and filtered by parity sketches, whose difference never exceeds the difference of the sets, so nothing
   is lost. A block names the sets that pass, never the pairs.
5. What passes is verified on the whole sets. Sets of a block meet again for that, lists of the same sets in one task, and
   only links between components that are still apart leave it: fewer than it has sets.

Defined results: null, empty and blank texts have the empty set and link with nothing; with fewer words than ``width``
the whole sequence is one shingle; texts with a null id are rows like others and never give a component its id (a
component of nulls only has a null id); repeated rows belong to one class; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

from .components import components
from .hashing import U, mix, packed_sorted, powers, unpacked_sorted

WIDTH, PERCENT = 4, 85
#: a shingle in so many texts is ordered by its count; others by hash
FREQUENT = 32
#: frequent shingles that every task gets; beyond it, the least frequent of them count as not frequent
MAX_FREQUENT = 1_000_000
#: ids that a join may send to all tasks
MAX_SENT = 500_000
#: sets of a list that meet all others of it
HUBS = 8
#: rounds in which a set meets one more hub
ROUNDS = 3
#: shingles or postings that one bucket holds, shingles that one task holds before it sends, and postings (24 bytes)
PER_BUCKET, PER_SEND, POSTINGS_PER_SEND = 500_000, 1_000_000, 500_000
#: postings of a list that meet at once, postings that share a task, and pairs that are looked at in one step
BLOCK, PER_MEETING, PAIRS_PER_STEP = 1024, 200_000, 500_000
#: shingles of the sets that meet at once, of the whole sets that share a task, and pairs that a task need not verify again
BLOCK_SHINGLES, PER_CHECK, REMEMBERED = 2_000_000, 1_000_000, 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    n = len(start)
    if not n:
        return np.empty(0, U)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum((_LOWER[raw].astype(U) + U(1)) * up[:-1], dtype=U)))
        words = mix((total[end] - total[start]) * down[start])
        k = min(width, n)
        grams = words[:n - k + 1]
        for j in range(1, k):
            grams = mix(grams * U(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j])
        if k < width:
            grams = mix(grams + U(k))
    return np.unique(grams)


def sketch_of(grams: np.ndarray) -> bytes:
    """Parities of the shingles in 2^b cells, b by the size of the set: 64 cells at least."""
    cells = 1 << max(6, int(len(grams) - 1).bit_length()) if len(grams) else 64
    odd = (np.bincount((grams & U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches with their cells folded down to ``size`` bytes."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The intersection that sets of these sizes need."""
    return -(-(percent * (a + b)) // (100 + percent))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    for batch in batches:
        yield batch.num_rows, batch.column(0).to_pylist(), batch.column(1)


def text_sets(docs: DataFrame, width: int, with_set: bool = False) -> DataFrame:
    """doc_id, n, key (64 bits of a digest of the set), and the sketch or the set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in _texts(batches):
            rows = []
            size = 0
            for key, value in zip(ids, texts):
                grams = shingles(value.as_py() or "", width)
                data = grams.tobytes() if with_set else sketch_of(grams)
                size += len(data)
                rows.append((key, len(grams), _key(grams), data))
                if size > 8_000_000:
                    yield _described(rows)
                    rows, size = [], 0
            if rows:
                yield _described(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        describe, "doc_id long, n long, key long, data binary")


def _key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n", "key", "data"])


def _by_bucket(values: np.ndarray, bits: int, bucket_bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending values of ``bits`` bits."""
    bucket = (values >> U(bits - bucket_bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges, [*edges[1:], len(values)])]


def frequent_shingles(docs: DataFrame, width: int, bits: int, bucket_bits: int, least: int) -> DataFrame:
    """(cell, texts): the cells of 2^bits in which ``least`` or more shingles of texts fall."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values, counts = np.unique(values, return_counts=True)
            rows = []
            for bucket, a, b in _by_bucket(values, bits, bucket_bits):
                more = np.flatnonzero(counts[a:b] > 1)
                rows.append((bucket, packed_sorted(values[a:b]), more.astype("<u4").tobytes(), counts[a:b][more].astype("<u4").tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "cells", "at", "counts"])

        for _, _, texts in _texts(batches):
            for value in texts:
                grams = shingles(value.as_py() or "", width) >> U(64 - bits)
                held.append(grams)
                size += len(grams)
                if size >= PER_SEND:
                    yield send()
                    size = 0
        if size:
            yield send()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        cells, counts = [], []
        for packed, at, more in zip(rows["cells"], rows["at"], rows["counts"]):
            one = unpacked_sorted(packed)
            n = np.ones(len(one), np.int64)
            n[np.frombuffer(at, "<u4")] = np.frombuffer(more, "<u4")
            cells.append(one)
            counts.append(n)
        cells, counts = np.concatenate(cells), np.concatenate(counts)
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.diff(cells, prepend=U(0) if len(cells) and cells[0] else U(1)) != 0)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        keep = sums >= least
        return pd.DataFrame({"cell": cells[first][keep].astype(np.int64), "texts": sums[keep]})

    sent = docs.select(F.lit(0).cast("long"), "text").mapInArrow(count, "bucket long, cells binary, at binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(add, "cell long, texts long")


def bounded_frequent(found: DataFrame, at_most: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells and counts as arrays. If there are more than ``at_most``, the least frequent are left out; any choice
    gives the same links, because the order only has to be the same for all sets."""
    least = 0
    while found.where(F.col("texts") >= least).count() > at_most:
        least = 2 * max(least, FREQUENT)
    table = found.where(F.col("texts") >= least).toArrow()
    cells, texts = table["cell"].to_numpy().astype(U), table["texts"].to_numpy()
    order = np.argsort(cells)
    return cells[order], texts[order]


def postings(docs: DataFrame, width: int, percent: int, bits: int, bucket_bits: int, frequent) -> DataFrame:
    """The index: the pairs of sets with hubs of their lists (key, other, n: in how many lists, at: 1 if one of them has no
    other pairs), and the postings of the lists that hold more sets than those pairs cover (gram, key, n, at, length)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, texts = frequent.value
        seen: set[int] = set()
        held, size = [], 0

        def send() -> pa.RecordBatch:
            gram, key, n, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(gram, kind="stable")
            gram, key, n, at = gram[order], key[order], n[order], at[order]
            rows = [(bucket, packed_sorted(gram[a:b]), key[a:b].tobytes(), n[a:b].tobytes(), at[a:b].tobytes())
                    for bucket, a, b in _by_bucket(gram, 48, bucket_bits)]
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "gram", "key", "n", "at"])

        for _, _, column in _texts(batches):
            for value in column:
                grams = shingles(value.as_py() or "", width)
                n = len(grams)
                if not n or (key := _key(grams)) in seen:
                    continue
                seen.add(key)
                cell = grams >> U(64 - bits)
                place = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
                often = np.where(cells[place] == cell, texts[place], 0) if len(cells) else np.zeros(n, np.int64)
                head = n - -(-percent * n // 100) + 1
                order = np.lexsort((grams, often))[:head]
                held.append((grams[order] >> U(16), np.full(head, key, np.int64), np.full(head, n, np.int32), np.arange(head, dtype=np.int32)))
                size += head
                if size >= POSTINGS_PER_SEND:
                    yield send()
                    size = 0
        if size:
            yield send()

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        gram = np.concatenate([unpacked_sorted(x) for x in rows["gram"]])
        key = np.concatenate([np.frombuffer(x, np.int64) for x in rows["key"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in rows["n"]]).astype(np.int64)
        at = np.concatenate([np.frombuffer(x, np.int32) for x in rows["at"]]).astype(np.int64)
        again = np.sort(gram)
        again = np.unique(again[1:][again[1:] == again[:-1]])
        several = np.isin(gram, again)
        gram, key, n, at = gram[several], key[several], n[several], at[several]
        # the same order of sets in every list, so the lists of a large group have the same hubs
        order = np.lexsort((key, mix(key.view(U)), gram))
        gram, key, n, at = gram[order], key[order], n[order], at[order]
        if len(gram):  # a set that two tasks have posted
            new = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
            gram, key, n, at = gram[new], key[new], n[new], at[new]
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.empty(0, np.int64)
        length = np.diff(np.r_[first, len(gram)])
        start, length = np.repeat(first, length), np.repeat(length, length)
        pairs, short = [np.empty((0, 2), np.int64)], [np.empty(0, bool)]
        for j in range(HUBS):
            p = np.flatnonzero(np.arange(len(gram)) > start + j)
            q = start[p] + j
            small, large = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
            keep = (small * 100 >= large * percent) & (
                1 + np.minimum(n[p] - at[p] - 1, n[q] - at[q] - 1) >= least_overlap(n[p], n[q], percent))
            pairs.append(np.stack((key[p[keep]], key[q[keep]]), axis=1))
            short.append(length[p[keep]] <= HUBS + 1)
        pairs, which, lists = np.unique(np.concatenate(pairs), axis=0, return_inverse=True, return_counts=True)
        short = np.bincount(which.ravel(), weights=np.concatenate(short), minlength=len(pairs)) > 0
        rest = length > HUBS + 1
        return pd.concat((
            pd.DataFrame({"gram": gram[rest].astype(np.int64), "key": key[rest], "n": n[rest], "at": at[rest], "other": None, "length": length[rest]}),
            pd.DataFrame({"gram": None, "key": pairs[:, 0], "n": lists, "at": short.astype(np.int64), "other": pairs[:, 1], "length": 0}))).astype(
            {"gram": "Int64", "other": "Int64"})

    sent = docs.select(F.lit(0).cast("long"), "text").mapInArrow(post, "bucket long, gram binary, key binary, n binary, at binary")
    return sent.groupBy("bucket").applyInPandas(index, "gram long, key long, n long, at long, other long, length long")


def near_sketches(da: list[bytes], db: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches differ by no more than those of linked sets may."""
    keep = np.zeros(len(da), bool)
    la, lb = np.array([len(x) for x in da], np.int64), np.array([len(x) for x in db], np.int64)
    kinds = la * (1 << 32) + lb
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        size = int(min(la[at[0]], lb[at[0]]))
        for k in range(0, len(at), 1 + 50_000_000 // int(la[at[0]] + lb[at[0]])):
            part = at[k:k + 1 + 50_000_000 // int(la[at[0]] + lb[at[0]])]
            a = folded(np.frombuffer(b"".join(da[i] for i in part), np.uint8).reshape(len(part), -1), size)
            b = folded(np.frombuffer(b"".join(db[i] for i in part), np.uint8).reshape(len(part), -1), size)
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            keep[part] = apart <= na[part] + nb[part] - 2 * least_overlap(na[part], nb[part], percent)
    return keep


def sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ by no more than linked sets may."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = near_sketches(list(rows["da"]), list(rows["db"]), rows["na"].to_numpy(), rows["nb"].to_numpy(), percent)
            yield rows.loc[keep, ["a", "b"]]

    side = lambda x: sketches.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("data").alias(f"d{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(near, "a long, b long")


def whole_sets(keys: DataFrame, docs: DataFrame, classes: DataFrame, width: int, label: str) -> DataFrame:
    """key, data: the sets of the distinct ``keys``."""
    wanted = as_table(keys.join(classes, "key").select(F.col("row").alias("doc_row"), "key"), f"{label}-wanted")
    few = wanted.count() <= MAX_SENT
    chosen = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("doc_row")), "left_semi")
    return as_table(text_sets(chosen, width, with_set=True).dropDuplicates(["key"]).join(
        F.broadcast(wanted.select("key")) if few else wanted.select("key"), "key", "left_semi").select("key", "data"), f"{label}-sets")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two whole sets link."""
    both = np.concatenate((np.frombuffer(x, U), np.frombuffer(y, U)))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = as_table(pairs, f"{label}-pairs")
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, classes, width, label)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.loc[[linked(x, y, percent) for x, y in zip(rows["da"], rows["db"])], ["a", "b"]]

    side = lambda x: sets.select(F.col("key").alias(x), F.col("data").alias(f"d{x}"))
    return as_table(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(exact, "a long, b long"), f"{label}-links")


def hub_links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """The links among ``pairs`` (key, other, lists, short) that join what is apart: (a, b), enough of them for the components
    of the short lists. Pairs of longer lists alone that are apart after the rounds meet in ``remaining_links``."""
    links = None
    for _ in range(rounds):
        chosen = as_table(pairs.groupBy("key").agg(F.max_by("other", "lists").alias("other")), "join-hub-chosen")
        found = verified(sketched(chosen.toDF("a", "b"), classes, percent), docs, classes, width, percent, "join-hub")
        links = found if links is None else as_table(links.union(found), "join-hub-links")
        joined = as_table(components(links, "join-stars"), "join-hub-joined")
        label = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        apart = pairs.join(chosen, ["key", "other"], "left_anti").join(label("key"), "key", "left").join(label("other"), "other", "left")
        pairs = as_table(apart.where(F.coalesce("c_key", "key") != F.coalesce("c_other", "other")).select("key", "other", "lists", "short"), "join-hub-apart")
        if pairs.isEmpty():
            return links
    rest = verified(sketched(pairs.where("short").select(F.col("key").alias("a"), F.col("other").alias("b")), classes, percent), docs, classes, width, percent, "join-hub")
    return links.union(rest)


def met(rows: pd.DataFrame, sketches: dict[int, bytes], percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows a and b of the pairs of different components that meet, past all bounds and sketches, a pair once a step; and
    their rows p and q in every list."""
    key, n, at, meeting, across, own, component = (
        rows[c].to_numpy() for c in ("key", "n", "at", "meeting", "across", "own", "component"))
    # (meeting, size) in one ascending number: the sets that a set can link with are the run behind it
    order = np.cumsum(np.r_[False, meeting[1:] != meeting[:-1]]) * (int(n.max(initial=0)) * 100 // percent + 2)
    end = np.searchsorted(order + n, order + np.minimum(n * 100 // percent, n.max(initial=0)), side="right")
    behind = end - np.arange(len(n)) - 1
    upto = np.cumsum(behind)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_PER_STEP, side="right")))
        run = behind[start:stop]
        p = np.repeat(np.arange(start, stop), run)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(run) - run, run)
        keep = (component[p] != component[q]) & (1 + np.minimum(n[p] - at[p] - 1, n[q] - at[q] - 1) >= least_overlap(n[p], n[q], percent))
        keep &= ~(across[p] & across[q] & (own[p] == own[q]))
        p, q = p[keep], q[keep]
        pairs, first, which = np.unique(np.stack((key[p], key[q]), axis=1), axis=0, return_index=True, return_inverse=True)
        a, b = p[first], q[first]
        near = near_sketches([sketches[k] for k in key[a]], [sketches[k] for k in key[b]], n[a], n[b], percent)
        yield a[near], b[near], p[near[which.ravel()]], q[near[which.ravel()]]
        start = stop


def remaining_links(index: DataFrame, joined: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) between different components in the lists that hold several, enough of them for all components.
    Long lists are cut into blocks, and each pair of blocks that size allows is met by itself."""
    labelled = index.join(joined.select(F.col("node").alias("key"), "component"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    several = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n").alias("shingles")).where("lo < hi")
    rows = as_table(labelled.join(several.select("gram", "shingles"), "gram").select(
        "gram", "length", "shingles", "key", "n", "at", "component"), "join-open")
    # rows of a long list go into blocks by hash; blocks i <= j meet by themselves. Many meetings share a task.
    blocks = F.ceil(F.greatest(F.col("length") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = rows.withColumns({"own": own, "blocks": blocks}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "own", "key", "n", "at", "component", F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
        (F.col("own") != F.col("other")).alias("across"))
    buckets = max(1, -(-rows.count() // PER_MEETING))
    first = dealt.withColumn("bucket", F.pmod("meeting", F.lit(buckets)))
    used = first.select(F.col("bucket").alias("part"), F.col("key").alias("set")).distinct().join(
        classes.select(F.col("key").alias("set"), F.col("data").alias("sketch")), "set").select("part", "set", "sketch")

    def passing(rows: pd.DataFrame, sketches: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["meeting", "n", "key"], kind="stable")
        marked = np.zeros(len(rows), bool)
        for _, _, p, q in met(rows, dict(zip(sketches["set"], sketches["sketch"])), percent):
            marked[p] = marked[q] = True
        return rows.loc[marked, ["own", "key", "n", "at", "component", "meeting", "across"]]

    near = as_table(first.groupBy("bucket").cogroup(used.groupBy("part")).applyInPandas(
        passing, "own int, key long, n long, at long, component long, meeting long, across boolean"), "join-near")
    # lists of the same sets have the same least set by hash: they share a task, which verifies a pair once
    again = as_table(near.join(near.groupBy("meeting").agg(F.min(F.xxhash64("key")).alias("unit")), "meeting"), "join-again")
    sets_of_unit = again.select("unit", "key", "n").distinct()
    buckets = max(1, -(-(sets_of_unit.agg(F.sum("n")).first()[0] or 0) // PER_CHECK))
    bucket = F.pmod("unit", F.lit(buckets))
    sets = whole_sets(again.select("key").distinct(), docs, classes, width, "join-rest")
    used = sets_of_unit.select(bucket.alias("part"), F.col("key").alias("set")).distinct().join(
        classes.select(F.col("key").alias("set"), F.col("data").alias("sketch")), "set").join(
        sets.select(F.col("key").alias("set"), "data"), "set").select("part", "set", "sketch", "data")

    def check(rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["meeting", "n", "key"], kind="stable")
        key, component = rows["key"].to_numpy(), rows["component"].to_numpy()
        whole = dict(zip(sets["set"], sets["data"]))
        above: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()
        found = []

        def root(c: int) -> int:
            while c in above:
                above[c] = c = above.get(above[c], above[c])
            return c

        for p, q, _, _ in met(rows, dict(zip(sets["set"], sets["sketch"])), percent):
            for a, b, x, y in zip(key[p].tolist(), key[q].tolist(), component[p].tolist(), component[q].tolist()):
                x, y = root(x), root(y)
                if x == y or (a, b) in apart:
                    continue
                if linked(whole[a], whole[b], percent):
                    above[x] = y
                    found.append((a, b))
                elif len(apart) < REMEMBERED:
                    apart.add((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return as_table(again.withColumn("bucket", bucket).groupBy("bucket").cogroup(used.groupBy("part")).applyInPandas(
        check, "a long, b long"), "join-rest-links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = as_table(text_sets(docs, width), "join-texts")
    classes = as_table(described.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("row"), F.first("n").alias("n"), F.first("data").alias("data")), "join-classes")
    total = described.agg(F.sum("n")).first()[0] or 0
    bits = min(56, max(24, total.bit_length() + 1))
    bucket_bits = min(20, max(4, (total // PER_BUCKET).bit_length()))
    cells = bounded_frequent(as_table(frequent_shingles(docs, width, bits, bucket_bits, FREQUENT), "join-frequent"), MAX_FREQUENT)
    frequent = spark.sparkContext.broadcast(cells)
    index = as_table(postings(docs, width, percent, bits, bucket_bits, frequent), "join-index")
    hub_pairs = as_table(index.where("other IS NOT NULL").groupBy("key", "other").agg(
        F.sum("n").alias("lists"), (F.max("at") > 0).alias("short")), "join-hub-pairs")
    links = hub_links(hub_pairs, docs, classes, width, percent)
    first = as_table(components(links, "join-stars"), "join-first")
    links = links.union(remaining_links(index.where("other IS NULL"), first, docs, classes, width, percent))
    joined = as_table(components(links, "join-stars"), "join-components")
    members = classes.select("key", "row").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    least = members.groupBy("component").agg(F.min("row").alias("component_id"))
    of_key = members.join(least, "component").select("key", "component_id")
    return described.join(of_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
