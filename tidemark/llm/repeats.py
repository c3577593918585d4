"""Exact removal of repeated passages over all texts as UTF-8 bytes.

A byte goes if it lies in a string of ``span`` bytes that also starts in a document with a smaller id. The suffix
order of a whole corpus is not built; it is built where it can matter, around anchors.

Anchors: a position is an anchor if the hash of its ``GRAM`` bytes is least in a run of ``span - GRAM + 1`` positions.
The rule depends on the bytes alone, so two equal strings of ``span`` bytes hold an anchor at the same place. Four
exchanges of hashes, each sorted and packed, never of texts:

1. Which anchor hashes occur in two documents? Each chunk of documents sends each hash once.
2. For those, the context (every string of ``span`` bytes that holds the anchor lies in it) is hashed. The least
   document of each context is found; in all later ones the whole context is a repeat. This settles copies, however
   many there are, with one row per chunk. Contexts are dealt by their own hash, and which anchors have several is
   found from two contexts per anchor and chunk.
3. Where an anchor has several contexts, the least document of each hashes the strings of ``span`` bytes (the heads)
   in it. These stretches are written down once, a few numbers a document, and nothing else is hashed from here on.
   Which heads occur in two documents? Each chunk sends each head once.
4. For those, each chunk sends the head and its least document, and the least of all is found: the string is a repeat
   in all later documents. No longest previous factor is computed; it reaches ``span`` exactly there.

Each chunk then marks its own documents. Every exchange is dealt by the hash of what it sends, and a chunk sends a
hash once, so an anchor in a third of all documents, with another context in each, is spread like any other: a bucket
holds its share of all hashes and one row per chunk of a hot one. The number of chunks and buckets grows with the
input; the chunked texts are a bucketed table, so no later pass moves texts.

Defined results: null and empty texts have no bytes; a null id is neither smaller nor larger, so such rows keep all
bytes and remove none; rows with the same id do not remove each other; texts shorter than ``span`` stay; an empty table
gives an empty table; other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table, shared_dir

from .hashing import U, mix, packed_sorted, powers, unpacked_sorted

SPAN, GRAM = 50, 20
#: bits of an anchor hash that the first exchange leaves out; it only has to tell most hashes apart
SHORT = U(16)
CHUNK_BYTES, BUCKET_BYTES = 6_000_000, 16_000_000
#: buckets of heads for each bucket of anchor hashes
FINER = 4
#: buckets that a table may have; with more chunks, a file holds several, which are still processed one by one
MOST_FILES = 100_000
#: bytes that are hashed in one step
HASHED_AT_ONCE = 100_000


def _run(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (or greatest) of every ``width`` neighbours, in log2(width) steps."""
    step = 1
    while 2 * step <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    return least(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def anchors(raw: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text."""
    if len(raw) < span:
        return np.empty(0, np.int64), np.empty(0, U)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * up[:-1], dtype=U)))
        h = (total[gram:] - total[:-gram]) * down[:len(raw) - gram + 1]
        # the order of positions needs 32 mixed bits
        rank = (((h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)) >> U(32)).astype(np.uint32)
    width = span - gram + 1
    least = _run(rank, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_run(np.concatenate((edge, least, edge)), width, np.maximum) == rank)
    with np.errstate(over="ignore"):
        return at, mix(h[at] * U(0x9E3779B97F4A7C15) + U(1))


def contexts(raw: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """A hash of the context of each anchor: up to ``span - gram`` bytes before it and ``span`` from it on."""
    up, down = powers(len(raw) + 1)
    start, end = np.maximum(at - (span - gram), 0), np.minimum(at + span, len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U), np.cumsum((mix(raw.astype(U)) | U(1)) * up[:-1], dtype=U)))
        h = mix((total[end] - total[start]) * down[start])
        return mix(h + (at - start).astype(U) * U(131) + (end - at).astype(U))


def heads(raw: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the string of ``span`` bytes at every position: 64 bits, and 32 more to be sure."""
    up, down = powers(len(raw) + 1)
    n = len(raw) - span + 1
    out = []
    with np.errstate(over="ignore"):
        for value in (raw.astype(U) + U(1), mix(raw.astype(U) + U(77))):
            total = np.concatenate((np.zeros(1, U), np.cumsum(value * up[:-1], dtype=U)))
            out.append(mix((total[span:] - total[:-span]) * down[:n] + U(len(out))))
    return mix(out[0] * U(0x9E3779B97F4A7C15) + U(1)), (out[1] >> U(32)).astype(np.uint32)


def _starts(length: int, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The starts of the strings of ``span`` bytes that hold one of the ascending anchors, as runs: (first, end) rows."""
    first, end = np.maximum(at - (span - gram), 0), np.minimum(at, length - span) + 1
    first, end = first[first < end], end[first < end]
    if not len(first):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])  # both ascend
    return np.stack((first[new], end[np.r_[new[1:], len(first)] - 1]), axis=1)


def _heads_of_runs(docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, heads, checks) of documents given as (bytes, runs). Only the runs are hashed, all at once."""
    pieces = [raw[a:b + SPAN - 1] for raw, runs in docs for a, b in runs]
    lengths = np.array([len(p) for p in pieces], np.int64)
    n_starts = np.array([sum(b - a for a, b in runs) for _, runs in docs], np.int64)
    starts = [np.concatenate([np.empty(0, np.int64), *[np.arange(a, b) for a, b in runs]]) for _, runs in docs]
    if not len(pieces):
        return [(x, np.empty(0, U), np.empty(0, np.uint32)) for x in starts]
    head, check = heads(np.concatenate(pieces))
    # windows that start in the last span - 1 bytes of a piece reach over its end
    inside = np.ones(int(lengths.sum()), bool)
    for end in np.cumsum(lengths):
        inside[end - SPAN + 1:end] = False
    inside = inside[:len(head)]
    cuts = np.cumsum(n_starts)[:-1]
    return list(zip(starts, np.split(head[inside], cuts), np.split(check[inside], cuts), strict=True))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among ``known``, ascending."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _chunk_anchors(texts: pd.DataFrame, shared: np.ndarray | None):
    """(doc_id, bytes, positions, hashes) per document of a chunk; only anchors with a shared short hash, if those are given."""
    for doc_id, text in zip(texts["doc_id"], texts["text"]):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        at, h = anchors(raw)
        if shared is not None and len(at):
            short = h >> SHORT
            place = np.minimum(np.searchsorted(shared, short), max(len(shared) - 1, 0))
            keep = shared[place] == short if len(shared) else np.zeros(len(h), bool)
            at, h = at[keep], h[keep]
        yield doc_id, raw, at, h


def _buckets(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending hashes, bucket by their upper bits."""
    bucket = ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges, [*edges[1:], len(hashes)])]


def shared_of(rows: pd.DataFrame) -> np.ndarray:
    if not len(rows):
        return np.empty(0, U)
    return np.sort(np.concatenate([unpacked_sorted(x) for x in rows["hashes"]]))


def _joined(rows: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in rows[column]]])


def _settled(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the answers to ``send_contexts``: anchors with several contexts, ascending; anchors, contexts and least
    documents of the repeated contexts by context; and the short hashes of all these anchors."""
    told = rows[rows["context"].notna()] if len(rows) else rows
    open_ = np.unique(_joined(rows[rows["context"].isna()] if len(rows) else rows, "anchor", U)) if len(rows) else np.empty(0, U)
    if not len(told):
        return open_, np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.unique(open_ >> SHORT)
    h, c, least = _joined(told, "anchor", U), _joined(told, "context", U), _joined(told, "least", np.int64)
    order = np.argsort(c, kind="stable")
    return open_, h[order], c[order], least[order], np.unique(np.concatenate((open_, h)) >> SHORT)


def _late(doc: int, c: np.ndarray, known: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which contexts stand in a smaller document."""
    if not len(known):
        return np.zeros(len(c), bool)
    place = np.minimum(np.searchsorted(known, c), len(known) - 1)
    return (known[place] == c) & (least[place] < doc)


def _ordered(texts: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk in an order that every pass finds again."""
    return texts.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)


def _counted(parts: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Arrays of (first, end) rows end to end, with their lengths."""
    return np.array([len(p) for p in parts], np.int64).tobytes(), np.concatenate([np.empty((0, 2), np.int64), *parts]).tobytes()


def _uncounted(lengths: bytes, rows: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(rows, np.int64).reshape(-1, 2), np.cumsum(np.frombuffer(lengths, np.int64))[:-1])


def _chunk_heads(texts: pd.DataFrame, opened: pd.DataFrame):
    """(doc_id, bytes, late ranges, starts, heads, checks) per document of a chunk: the ranges of contexts that stand in
    a smaller document, and the heads in the other contexts of anchors that have several."""
    texts = _ordered(texts)
    if len(opened):
        row = opened.iloc[0]
        ranges, runs = _uncounted(row["n_ranges"], row["ranges"]), _uncounted(row["n_runs"], row["runs"])
    else:
        ranges = runs = [np.empty((0, 2), np.int64)] * len(texts)
    held, size = [], 0

    def hashed():
        found = _heads_of_runs([(raw, runs[i]) for i, raw in held])
        for (i, raw), (start, head, check) in zip(held, found, strict=True):
            yield texts["doc_id"].iat[i], raw, ranges[i].T, start, head, check

    for i, text in enumerate(texts["text"]):
        held.append((i, np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)))
        size += int((runs[i][:, 1] - runs[i][:, 0]).sum()) + 100
        if size > HASHED_AT_ONCE:
            yield from hashed()
            held, size = [], 0
    yield from hashed()


class Steps:
    """The functions that run in tasks, for given numbers of buckets."""

    def __init__(self, n_buckets: int):
        self.n = n_buckets

    def send_hashes(self, texts: pd.DataFrame) -> pd.DataFrame:
        """Each anchor hash of the chunk once, and which occur in two of its documents."""
        return self.packed([np.unique(h >> SHORT) for _, _, _, h in _chunk_anchors(texts, None)], int(texts["chunk"].iloc[0]))

    def packed(self, found: list[np.ndarray], chunk: int, short=SHORT) -> pd.DataFrame:
        """One row per bucket from the distinct hashes of each document, without their last ``short`` bits."""
        h, times = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame(
            [(b, chunk, packed_sorted(h[x:y]), np.packbits(times[x:y] > 1).tobytes()) for b, x, y in _buckets(h << U(short), self.n)],
            columns=["bucket", "chunk", "hashes", "several"])

    @staticmethod
    def find_shared(rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk the hashes that two documents hold, anywhere. A document is in one chunk."""
        parts = [unpacked_sorted(x) for x in rows["hashes"]]
        h = np.concatenate(parts)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows["several"], parts)])
        _, which, chunks = np.unique(h, return_inverse=True, return_counts=True)
        shared = (chunks > 1) | (np.bincount(which, weights=several) > 0)
        hit = shared[which]
        out, at = [], 0
        for chunk, part in zip(rows["chunk"], parts):
            keep = part[hit[at:at + len(part)]]
            at += len(part)
            if len(keep):
                out.append((chunk, packed_sorted(keep)))
        return pd.DataFrame(out, columns=["chunk", "hashes"])

    def send_contexts(self, texts: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        """Each context of the chunk once, with its least document, dealt by context; and each anchor once with its
        least and greatest context, dealt by anchor, to buckets behind the others."""
        columns = ["bucket", "chunk", "anchor", "context", "least", "more"]
        if not len(texts) or not len(shared):
            return pd.DataFrame(columns=columns)
        chunk = int(texts["chunk"].iloc[0])
        found = [(h, contexts(raw, at), np.full(len(at), d, np.int64)) for d, raw, at, h in _chunk_anchors(texts, shared_of(shared))]
        h, c, d = (np.concatenate(x) for x in zip(*found))
        if not len(h):
            return pd.DataFrame(columns=columns)
        order = np.lexsort((d, h, c))
        h, c, d = h[order], c[order], d[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        last = np.r_[first[1:], len(h)] - 1
        more = d[first] != d[last]
        h, c, d = h[first], c[first], d[first]
        rows = [(b, chunk, h[x:y].tobytes(), c[x:y].tobytes(), d[x:y].tobytes(), more[x:y].tobytes()) for b, x, y in _buckets(c, self.n)]
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        last = np.r_[first[1:], len(h)] - 1
        h, low, high = h[first], c[first], c[last]
        rows += [(self.n + b, chunk, h[x:y].tobytes(), low[x:y].tobytes(), None, (low[x:y] != high[x:y]).tobytes()) for b, x, y in _buckets(h, self.n)]
        return pd.DataFrame(rows, columns=columns)

    def settle_contexts(self, rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk the least document of the contexts that it has in a later one too, or the anchors that have
        several contexts."""
        columns = ["chunk", "anchor", "context", "least"]
        sizes = [len(x) // 8 for x in rows["anchor"]]
        h, c, more = _joined(rows, "anchor", U), _joined(rows, "context", U), _joined(rows, "more", np.bool_)
        chunk = np.repeat(rows["chunk"].to_numpy(), sizes)
        by_context = int(rows["bucket"].iloc[0]) < self.n
        if by_context:
            d = _joined(rows, "least", np.int64)
            order = np.lexsort((d, h, c))
            h, c, d, more, chunk = h[order], c[order], d[order], more[order], chunk[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            least = np.repeat(d[new], np.diff(np.r_[new, len(h)]))
            # a chunk needs the answer if it has later documents with the context
            tell = more | (d > least)
            h, c, least, chunk = h[tell], c[tell], least[tell], chunk[tell]
        else:
            order = np.argsort(h, kind="stable")
            h, c, more, chunk = h[order], c[order], more[order], chunk[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = (np.minimum.reduceat(c, new) != np.maximum.reduceat(c, new)) | np.logical_or.reduceat(more, new)
            tell = np.repeat(several, np.diff(np.r_[new, len(h)]))
            h, chunk = h[tell], chunk[tell]
        order = np.argsort(chunk, kind="stable")
        h, chunk = h[order], chunk[order]
        if by_context:
            c, least = c[order], least[order]
        edges = np.flatnonzero(np.diff(chunk, prepend=-1))
        return pd.DataFrame(
            [(int(chunk[x]), h[x:y].tobytes(), *((c[x:y].tobytes(), least[x:y].tobytes()) if by_context else (None, None)))
             for x, y in zip(edges, [*edges[1:], len(chunk)])], columns=columns)

    @staticmethod
    def open_contexts(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """One row for the chunk: of each document the ranges that stand in a smaller one, and the runs of starts whose
        heads are still open."""
        columns = ["chunk", "n_ranges", "ranges", "n_runs", "runs"]
        if not len(texts) or not len(answers):
            return pd.DataFrame(columns=columns)
        open_, _, known, least, shared = _settled(answers)
        left, ranges, runs = SPAN - GRAM, [], []
        for doc, raw, at, h in _chunk_anchors(_ordered(texts), shared):
            if not len(at):
                ranges.append(np.empty((0, 2), np.int64))
                runs.append(np.empty((0, 2), np.int64))
                continue
            late = _late(doc, contexts(raw, at), known, least)
            a, b = np.maximum(at - left, 0), np.minimum(at + SPAN, len(raw))
            whole = late & (b - a >= SPAN)
            ranges.append(np.stack((a[whole], b[whole]), axis=1))
            runs.append(_starts(len(raw), at[~late & _within(h, open_)]))
        return pd.DataFrame([(int(texts["chunk"].iloc[0]), *_counted(ranges), *_counted(runs))], columns=columns)

    def send_heads(self, texts: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        """Each head of the chunk once, and which occur in two of its documents."""
        columns = ["bucket", "chunk", "hashes", "several"]
        if not len(texts) or not len(opened):
            return pd.DataFrame(columns=columns)
        found = [np.unique(head >> SHORT) for *_, head, _ in _chunk_heads(texts, opened) if len(head)]
        finer = Steps(FINER * self.n)
        return finer.packed(found, int(texts["chunk"].iloc[0])) if found else pd.DataFrame(columns=columns)

    def send_least(self, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Each shared head of the chunk once, with its least document."""
        columns = ["bucket", "chunk", "head", "check", "least", "more"]
        opened, shared = _parted(answers)
        if not len(texts) or not len(shared):
            return pd.DataFrame(columns=columns)
        shared, found = shared_of(shared), [(np.empty(0, U), np.empty(0, np.uint32), np.empty(0, np.int64))]
        for doc, _, _, _, head, check in _chunk_heads(texts, opened):
            keep = _within(head >> SHORT, shared) if len(head) else np.empty(0, bool)
            if keep.any():
                found.append((head[keep], check[keep], np.full(int(keep.sum()), doc, np.int64)))
        g, k, d = (np.concatenate(x) for x in zip(*found))
        if not len(g):
            return pd.DataFrame(columns=columns)
        order = np.lexsort((d, k, g))
        g, k, d = g[order], k[order], d[order]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        last = np.r_[first[1:], len(g)] - 1
        more = d[first] != d[last]
        g, k, d = g[first], k[first], d[first]
        return pd.DataFrame(
            [(b, int(texts["chunk"].iloc[0]), g[x:y].tobytes(), k[x:y].tobytes(), d[x:y].tobytes(), more[x:y].tobytes())
             for b, x, y in _buckets(g, FINER * self.n)], columns=columns)

    @staticmethod
    def settle_heads(rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk the least document of the heads that it has in a later one."""
        sizes = [len(x) // 8 for x in rows["head"]]
        g, k, d, more = (_joined(rows, c, kind) for c, kind in (("head", U), ("check", np.uint32), ("least", np.int64), ("more", np.bool_)))
        chunk = np.repeat(rows["chunk"].to_numpy(), sizes)
        order = np.lexsort((d, k, g))
        g, k, d, more, chunk = g[order], k[order], d[order], more[order], chunk[order]
        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        least = np.repeat(d[new], np.diff(np.r_[new, len(g)]))
        tell = more | (d > least)
        g, k, least, chunk = g[tell], k[tell], least[tell], chunk[tell]
        order = np.argsort(chunk, kind="stable")
        g, k, least, chunk = g[order], k[order], least[order], chunk[order]
        edges = np.flatnonzero(np.diff(chunk, prepend=-1))
        return pd.DataFrame(
            [(int(chunk[x]), g[x:y].tobytes(), k[x:y].tobytes(), least[x:y].tobytes()) for x, y in zip(edges, [*edges[1:], len(chunk)])],
            columns=["chunk", "head", "check", "least"])

    @staticmethod
    def mark(texts: pd.DataFrame, answers: pd.DataFrame, with_text: bool) -> pd.DataFrame:
        """The removed ranges of each document of the chunk."""
        opened, some = _parted(answers, "head")
        g, k, least = _joined(some, "head", U), _joined(some, "check", np.uint32), _joined(some, "least", np.int64)
        order = np.lexsort((k, g))
        g, k, least = g[order], k[order], least[order]
        out = []
        for doc, raw, ranges, start, head, check in _chunk_heads(texts, opened):
            step = np.zeros(len(raw) + 1, np.int64)
            np.add.at(step, ranges[0], 1)
            np.add.at(step, ranges[1], -1)
            if len(start) and len(g):
                # heads that differ only in their check lie side by side: there are hardly ever two
                place, end = np.searchsorted(g, head), np.searchsorted(g, head, side="right")
                while (open_ := place < end).any():
                    near = place[open_]
                    hit = (k[near] == check[open_]) & (least[near] < doc)
                    np.add.at(step, start[open_][hit], 1)
                    np.add.at(step, start[open_][hit] + SPAN, -1)
                    place = place + 1
            gone = np.cumsum(step[:-1]) > 0
            kept = raw[~gone].tobytes()
            n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            row = (doc, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if with_text else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
        return pd.DataFrame(out, columns=names)


def _parted(answers: pd.DataFrame, later: str = "hashes") -> tuple[pd.DataFrame, pd.DataFrame]:
    """The row of open runs, and the answers that hold the column ``later``."""
    if not len(answers):
        return answers, answers
    hit = answers[later].notna()
    return answers[~hit], answers[hit]


def chunked(rows: DataFrame, n_chunks: int, label: str) -> DataFrame:
    """``rows`` as a table bucketed by their ``chunk``, so that grouping by it moves nothing."""
    spark = rows.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    files = min(n_chunks, MOST_FILES)
    rows.repartition(files, "chunk").write.bucketBy(files, "chunk").option(
        "path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, with_text: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes if asked for."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-size // CHUNK_BYTES))
    steps = Steps(max(1, -(-size // BUCKET_BYTES)))
    ordered = rows.where("doc_id IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_chunks)).cast("int"))
    texts = chunked(ordered, n_chunks, "repeats")

    def answered(answers: DataFrame, function, schema: str) -> DataFrame:
        return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(function, schema)

    sent = texts.groupBy("chunk").applyInPandas(lambda t: steps.send_hashes(t), "bucket long, chunk int, hashes binary, several binary")
    shared = as_table(sent.groupBy("bucket").applyInPandas(steps.find_shared, "chunk int, hashes binary"), "repeats-shared")
    sent = answered(shared, lambda t, a: steps.send_contexts(t, a), "bucket long, chunk int, anchor binary, context binary, least binary, more binary")
    settled = as_table(sent.groupBy("bucket").applyInPandas(
        lambda r: steps.settle_contexts(r), "chunk int, anchor binary, context binary, least binary"), "repeats-contexts")
    opened = as_table(answered(settled, steps.open_contexts, "chunk int, n_ranges binary, ranges binary, n_runs binary, runs binary"), "repeats-open")
    sent = answered(opened, lambda t, a: steps.send_heads(t, a), "bucket long, chunk int, hashes binary, several binary")
    known = as_table(sent.groupBy("bucket").applyInPandas(steps.find_shared, "chunk int, hashes binary"), "repeats-heads")
    asked = opened.unionByName(known, allowMissingColumns=True)
    sent = answered(asked, lambda t, a: steps.send_least(t, a), "bucket long, chunk int, head binary, check binary, least binary, more binary")
    least = as_table(sent.groupBy("bucket").applyInPandas(
        steps.settle_heads, "chunk int, head binary, check binary, least binary"), "repeats-least")
    answers = opened.unionByName(least, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    marked = answered(answers, lambda t, a: steps.mark(t, a, with_text), schema)
    raw = F.to_binary("text", F.lit("utf-8"))
    unordered = rows.where("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([raw.alias("kept")] if with_text else []))
    return marked.unionByName(unordered)
