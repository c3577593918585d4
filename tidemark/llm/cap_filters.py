"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction on the sphere; a vector passes those whose cosine with it exceeds a threshold. Directions are
products: the vector is turned by a fixed random rotation and cut in halves, each half has its own code of random
directions, and a filter is a pair of them. All passing pairs are listed by decoding: the sorted scores of one half
are cut off at what the score of the other half leaves to reach. Vectors that meet in a filter are verified by their
cosine in double precision; a link counts in the first common filter of its vectors only. A meeting gives each vector its
number of links and one vector that they lead to, never the pairs themselves.

Filters grow with the number of vectors so that the expected number of vectors in one stays the same, and the
threshold follows from the wanted number of filters per vector. Exact copies are one class from the start. A filter
that holds many vectors of one cluster is cut into blocks, and pairs of blocks meet in different tasks.

The threshold of the cosine is exact; the search is probabilistic (a pair that shares no filter is missed). Measured
recall is in the README.

Defined results: a null id, vector or label, a null or non-finite component, no components, or zero length: the row
links with nothing, has its own id as component and is kept. Vectors of different length are never compared.
Repeated rows are one class; rows that share an id are one node. An empty table gives an empty table; other columns
of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

from .components import components

LEAST_COSINE = 0.98
#: expected filters per vector
FILTERS_PER_VECTOR = 40
#: classes of exact copies that hold more than one row in so many are told to their rows by broadcast: at most this many
HOT_CLASSES = 500
#: vectors that meet in one step, and rows in one bucket of filters
BLOCK, PER_BUCKET = 1024, 40_000
SEED = 20_240_229


@lru_cache(maxsize=4)
def _codes(dims: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two codes of unit directions, the same wherever they are made."""
    random = np.random.default_rng([SEED, dims, size])
    rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
    halves = []
    for width in (dims // 2, dims - dims // 2):
        code = random.standard_normal((size, max(width, 1)))
        halves.append(code / np.linalg.norm(code, axis=1, keepdims=True))
    return rotation, *halves


@lru_cache(maxsize=64)
def threshold(dims: int, size: int, wanted: float = FILTERS_PER_VECTOR) -> float:
    """The score that a random vector exceeds in ``wanted`` of size * size filters, from a fixed random sample."""
    random = np.random.default_rng([SEED, dims])
    sample = random.standard_normal((256, dims))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    first, second = _scores(sample, dims, size)
    some = np.arange(0, size * size, max(1, size * size // 65_536))
    scores = np.empty((len(sample), len(some)))
    for row, a, b in zip(scores, first, second):
        np.add(a[some // size], b[some % size], out=row)
    return float(np.quantile(scores, 1 - min(0.5, wanted / (size * size)), overwrite_input=True))


def _scores(x: np.ndarray, dims: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    rotation, one, two = _codes(dims, size)
    turned = x @ rotation
    if dims < 2:
        return turned @ one[:, :1].T, np.zeros((len(x), size))
    return turned[:, :dims // 2] @ one.T, turned[:, dims // 2:] @ two.T


def decode(first: np.ndarray, second: np.ndarray, least: float) -> np.ndarray:
    """All pairs (i, j) with first[i] + second[j] >= least, as i * len(second) + j, ascending."""
    order = np.argsort(-second)
    falling = -second[order]
    rows = np.flatnonzero(first + second.max() >= least)
    upto = np.searchsorted(falling, first[rows] - least, side="right")
    columns = np.concatenate([order[:u] for u in upto]) if len(rows) else np.empty(0, np.int64)
    return np.sort(np.repeat(rows, upto) * len(second) + columns)


def _vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, data (doubles) of each row; data is null where the row cannot link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for key, label, vector in zip(batch.column(0), batch.column(1), batch.column(2)):
                value = None
                if key.is_valid and label.is_valid and vector.is_valid and len(vector) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        value = x.tobytes()
                data.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) // 8 if x else 0 for x in data], pa.int32()), pa.array(data, pa.binary())],
                ["vec_id", "label", "dims", "data"])

    return vectors.mapInArrow(read, "vec_id long, label string, dims int, data binary")


def _units(data: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def posted(classes: DataFrame, size: int, wanted: float) -> DataFrame:
    """node, label, dims, filter, filters (all of the node): one row per filter that a vector passes."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels: dict[int, float] = {}
        for rows in batches:
            for dims, own in rows.groupby("dims"):
                if dims not in levels:
                    levels[dims] = threshold(int(dims), size, wanted)
                first, second = _scores(_units(list(own["data"]), int(dims)), int(dims), size)
                lists = [decode(a, b, levels[dims]) for a, b in zip(first, second)]
                n = [len(x) for x in lists]
                yield pd.DataFrame({
                    "node": np.repeat(own["node"].to_numpy(), n), "label": np.repeat(own["label"].to_numpy(), n),
                    "dims": np.int32(dims), "filter": np.concatenate(lists) if lists else [],
                    "filters": np.repeat(np.array([x.astype("<i8").tobytes() for x in lists], object), n)}).astype({"filter": "int64", "dims": "int32"})

    return classes.select("node", "label", "dims", "data").mapInPandas(post, "node long, label string, dims int, filter long, filters binary")


def _least_reachable(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that can be reached from it."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def links_of(classes: DataFrame, size: int, wanted: float, least: float) -> DataFrame:
    """a, b, n: class ``a`` has links to ``n`` rows of other classes of its label in one meeting, all of a cosine of
    ``least`` or more, and reaches class ``b`` by them. Each link is counted in one meeting only, and a meeting gives one
    row per class, however many links its classes have."""
    rows = as_table(posted(classes, size, wanted), "caps-posted")
    sizes = rows.groupBy("label", "dims", "filter").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes, ["label", "dims", "filter"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "node", "filters", "dims", "filter", "own",
        F.xxhash64("label", "dims", "filter", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
        (F.least("own", "other") != F.greatest("own", "other")).alias("across"))
    dealt = as_table(dealt, "caps-dealt")
    buckets = max(1, -(-dealt.count() // PER_BUCKET))
    whole = dealt.join(classes.select("node", "data", "copies"), "node").withColumn("bucket", F.pmod("meeting", F.lit(buckets)))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["meeting", "node"], kind="stable")
        meeting, node, own, across, filter_, dims, copies = (
            rows[c].to_numpy() for c in ("meeting", "node", "own", "across", "filter", "dims", "copies"))
        data, filters = list(rows["data"]), list(rows["filters"])
        edges = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1], True])
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            x = _units(data[a:b], int(dims[a]))
            close = np.triu(x @ x.T >= least, 1)
            if across[a]:
                close &= own[a:b, None] != own[None, a:b]
            close |= close.T
            some = np.flatnonzero(close.any(axis=1))
            if not len(some):
                continue
            close = close[np.ix_(some, some)]
            # who shares an earlier filter has met there
            lists = [np.frombuffer(filters[a + i], "<i8") for i in some]
            earlier = [x[:np.searchsorted(x, filter_[a])] for x in lists]
            shared, owner = np.concatenate(earlier), np.repeat(np.arange(len(some)), [len(x) for x in earlier])
            order = np.argsort(shared, kind="stable")
            for met in np.split(owner[order], np.flatnonzero(np.diff(shared[order])) + 1):
                if len(met) > 1:
                    close[np.ix_(met, met)] = False
            n, nodes = close @ copies[a + some], node[a + some]
            reached, linked = nodes[_least_reachable(close)], np.flatnonzero(n)
            out.append(pd.DataFrame({"a": nodes[linked], "b": reached[linked], "n": n[linked]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")

    return as_table(whole.groupBy("bucket").applyInPandas(meet, "a long, b long, n long"), "caps-links")


def _tell(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Every row with what its class says. Rows that link with nothing meet nobody, and copies of a hot vector stay
    where they are."""
    columns = ["vec_id", "n_links", "component_id"]
    usable = rows.where("data IS NOT NULL")
    hot = described.where(F.col("copies") > max(1, usable.count() // HOT_CLASSES)).select("label", "data", F.col("n_links").alias("hot_links"), F.col("component_id").alias("hot_component"))
    marked = usable.join(F.broadcast(hot), ["label", "data"], "left")
    alone = rows.where("data IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    of_hot = marked.where("hot_links IS NOT NULL").select("vec_id", F.col("hot_links").alias("n_links"), F.col("hot_component").alias("component_id"))
    others = marked.where("hot_links IS NULL").join(described, ["label", "data"]).select(*columns)
    return others.unionByName(of_hot).unionByName(alone)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, wanted: float = FILTERS_PER_VECTOR,
                    id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = as_table(_vectors(vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("embedding"))), "caps-vectors")
    grouped = as_table(rows.where("data IS NOT NULL").groupBy("label", "dims", "data").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies")), "caps-classes")
    n = grouped.count()
    size = 1 << max(4, (max(n, 1).bit_length() + 1) // 2)
    links = links_of(grouped, size, wanted, least)
    beside = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = components(links.where("a <> b").select("a", "b").distinct(), "caps-stars").select("node", "component")
    described = grouped.join(beside, "node", "left").join(joined, "node", "left").select(
        "label", "data", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    return _tell(rows, as_table(described, "caps-described")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
