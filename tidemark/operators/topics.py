"""One topic model over both periods: TF-IDF of words and word pairs, factored by non-negative least squares.

The weighted posts X are approximated by W H, with W >= 0 per post and H >= 0 per term. For a given H the
weights of a post depend on that post alone, so W is never stored: a pass over the posts solves W row by row
and returns W'W and W'X, which is all that the next H needs. Passes read a table in the shared folder.

Terms are numbered by falling frequency. The model counts them as keys of one or two numbered words (``term_keys``), in
groups of terms. A vocabulary that fits the head, of a bounded size, is looked up and weighed where posts are read, and its
factor travels to the tasks (``term_factor``); with more terms, the tasks keep the groups and W travels, never H
(``term_blocks``). The model is the same however many terms are in the head. ``tfidf`` weighs posts in chunks, which learn
from groups of terms how many posts have each (``term_weights``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import bind, topic_tokens
from ..sizes import settle
from ..storage import as_table, shuffles_dropped
from .term_blocks import Derived, TermBlocks
from .term_factor import HEAD_TERMS, PIECE, Factor, Matrix, SparseRows, Terms, lists, normal_rows
from .term_keys import HEAD_WORDS, WORD_BYTES, CodedPosts, Words, as_bytes, coded, split_words
from .term_weights import weights

LOSS_TOLERANCE = 1e-3
START_PASSES = 3
#: words, or entries, that a task works on at once, and terms that it counts before it sends them
AT_ONCE, COUNTED = 200_000, 500_000
#: rows of weights that are solved at once
SOLVED = 8_192
_TINY = 1e-12


# --- vocabulary and weights -----------------------------------------------------------------


def vocabulary_tokens(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Topic view, cut at apostrophes into words of two letters or more."""
    joined = F.array_join(topic_tokens(text, stop_words), " ")
    return F.regexp_extract_all(joined, F.lit("([a-z]{2,})"), 1)


def words_and_pairs(tokens: Column) -> Column:
    """The tokens and every two neighbours joined by a space."""
    return bind(tokens, lambda words: F.concat(words, F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda first, second: F.concat(first, F.lit(" "), second))))


def vocabulary(
    terms: DataFrame, documents: int, min_documents: int = fixed.MIN_DOCUMENTS,
    max_share: float = fixed.MAX_DOCUMENT_SHARE,
) -> DataFrame:
    """``term, documents, idf`` from a frame with an array ``terms``; too rare and too common terms are left out.

    Each post counts a term once before anything is exchanged, and tasks add up their terms first.
    """
    counts = terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(
        F.count("*").alias("documents"))
    return _kept(counts, documents, min_documents, max_share)


def _kept(counts: DataFrame, documents: int, min_documents: int = fixed.MIN_DOCUMENTS, max_share: float = fixed.MAX_DOCUMENT_SHARE) -> DataFrame:
    kept = counts.filter((F.col("documents") >= min_documents) & (F.col("documents") <= max_share * documents))
    return kept.withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("documents"))) + 1)


def _entries(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words and pairs of a batch of ``_tokens``; and row, distinct term and number of each entry, by row."""
    tokens_of = batch.column("_tokens")
    tokens = tokens_of.flatten().cast(pa.string())
    row = np.repeat(np.arange(batch.num_rows), np.diff(tokens_of.offsets.to_numpy()))
    first = np.flatnonzero(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(tokens.take(pa.array(first)), tokens.take(pa.array(first + 1)), " ")
    coded = pa.concat_arrays([tokens, pairs]).dictionary_encode()
    names = max(len(coded.dictionary), 1)
    entries, n = np.unique(np.concatenate([row, row[first]]) * names + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, entries // names, entries % names, n


def _sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = AT_ONCE, unit: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches whose lists or byte strings in ``column`` have no more than ``most`` values, of ``unit`` bytes, but for the last
    row: batches are cut by rows, and rows of texts may be of any length."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        ends = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // unit
        part = np.r_[0, ends[:-1] // most] if len(ends) else ends
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _word_counts(posts: DataFrame, min_documents: int) -> DataFrame:
    """``term, documents`` of the single words of ``_words`` that a vocabulary with pairs may need."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("documents", "sum")]).rename_columns(["term", "documents"])

        for batch in _sliced(batches, "_words", unit=WORD_BYTES):
            ends, found = split_words(batch.column("_words"))
            names = max(len(found.dictionary), 1)
            which = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(ends)) * names + found.indices.to_numpy()) % names
            held.append(pa.table([found.dictionary, pa.array(np.bincount(which, minlength=len(found.dictionary)))], names=["term", "documents"]))
            size += len(found.dictionary)
            if size >= 2 * COUNTED:
                held = [added()]
                size = held[0].num_rows
                if size >= COUNTED:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from added().to_batches()

    counts = posts.select("_words").mapInArrow(count, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))
    return counts.where((F.col("documents") >= min_documents) & (F.col("term") != ""))


@dataclass
class Vocabulary:
    """Terms with their places by falling frequency: the head as ``term, idf``, the others as a table with ``place``."""

    terms: Terms
    head: pa.Table
    tail: DataFrame | None = None


class KeyedVocabulary:
    """The vocabulary of a model beyond the head, which is spelled when asked for."""

    def __init__(self, blocks: TermBlocks):
        self.blocks, self.terms = blocks, blocks.terms

    @cached_property
    def head(self) -> pa.Table:
        return self._spelled(F.col("place") < self.terms.head).toArrow().sort_by("place").select(["term", "idf"])

    @property
    def tail(self) -> DataFrame:
        return self._spelled(F.col("place") >= self.terms.head)

    def _spelled(self, which: Column) -> DataFrame:
        return self.blocks.words.spelled(self.blocks.vocabulary().where(which))


def tfidf(
    df: DataFrame, text_col: str = "text", id_col: str = "post_id", keep: Sequence[str] = (), head_terms: int = HEAD_TERMS,
    piece: int = PIECE, min_documents: int = fixed.MIN_DOCUMENTS, max_share: float = fixed.MAX_DOCUMENT_SHARE,
) -> DataFrame:
    """``id, term, weight`` (and ``keep``) in long form, with unit length per post. Posts that share an id stay apart.

    Up to ``head_terms`` frequent words are looked up where posts are read, others in a join; ``piece`` has no effect here.
    """
    keep = [id_col, *keep]
    posts = _stored(_joined(df, text_col, keep))
    words = Words.of(_word_counts(posts, min_documents), head_terms)
    kept = [*keep, "_spelled"]
    return weights(_coded(posts.withColumn("_spelled", F.col("_words")), words, kept), keep, "_spelled", min_documents, max_share)


# --- weights of posts -----------------------------------------------------------------------


def _joined(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """The words of each text in one string: lists of strings pass to Python one by one."""
    words = F.coalesce(F.array_join(vocabulary_tokens(F.col(text_col)), " "), F.lit(""))
    return df.select(*[F.col(f"`{c}`") for c in keep], words.alias("_words"))


def _stored(posts: DataFrame) -> DataFrame:
    """Posts whose words are counted before they are coded. New posts are only coded, once, and need no table of words."""
    return as_table(posts, "words", compression="zstd")


def _coded(posts: DataFrame, words: Words, keep: Sequence[str]) -> CodedPosts:
    return CodedPosts(coded(posts, words, keep, lambda batches: _sliced(batches, "_words", unit=WORD_BYTES)), keep)


def least_squares_weights(cross: np.ndarray, gram: np.ndarray, sweeps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative W of min |X - W H| from X H' and H H', by cyclic coordinate descent over all rows at once."""
    scale = max(float(np.abs(cross).max(initial=0.0)), _TINY) / max(float(gram.diagonal().max()), _TINY)
    found = np.zeros(cross.shape)
    for a in range(0, len(cross), SOLVED):  # as many rows as stay in a core's cache, by columns
        part = np.ascontiguousarray(cross[a:a + SOLVED].T)
        w = np.zeros_like(part)
        for _ in range(sweeps):
            change = 0.0
            for k in range(len(gram)):
                if gram[k, k] > _TINY:
                    new = np.maximum(0.0, w[k] + (part[k] - gram[:, k] @ w) / gram[k, k])
                    change = max(change, float(np.abs(new - w[k]).max(initial=0.0)))
                    w[k] = new
            if change <= tolerance * scale:
                break
        found[a:a + SOLVED] = w.T
    return found


def _weigh(posts: DataFrame, words: Vocabulary, keep: Sequence[str]) -> DataFrame:
    """``keep, terms, weights`` of unit length from ``_tokens``, in the bytes that ``SparseRows`` reads.

    Terms are looked up in the task; the table of them is made once per task.
    """
    shared = posts.sparkSession.sparkContext.broadcast((words.head.column("term").to_pylist(), words.head.column("idf").to_numpy()))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        places = dict(zip(known, range(len(known))))
        for batch in _sliced(batches, "_tokens"):
            names, row, which, n = _entries(batch)
            place = np.fromiter((places.get(name, -1) for name in names.to_pylist()), np.int64, len(names))[which]
            found = place >= 0
            row, place = row[found], place[found]
            value = (1 + np.log(n[found])) * idf[place]
            value = value / np.sqrt(np.bincount(row, value * value, batch.num_rows))[row]
            order = np.lexsort((place, row))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            kept = [name for name in batch.schema.names if name != "_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], as_bytes(place[order], ends), as_bytes(value[order], ends)], [*kept, "terms", "weights"])

    fields = "".join(f"`{name}` {posts.schema[name].dataType.simpleString()}, " for name in keep)
    return posts.select(*[F.col(f"`{c}`") for c in keep], "_tokens").mapInArrow(lookup, f"{fields}terms binary, weights binary")


# --- the model ------------------------------------------------------------------------------


@dataclass
class TopicModel:
    """A fitted model: the factor H as terms by topics, and the weighted posts of the fit."""

    n_topics: int
    posts: Matrix | TermBlocks
    losses: list[float]
    vocabulary: Vocabulary | KeyedVocabulary
    loadings: Factor

    @property
    def factors(self) -> DataFrame:
        """``term, idf, loadings array<double>``, one row per term."""
        if isinstance(self.posts, Matrix):
            return self.posts.x.sparkSession.createDataFrame(
                self.vocabulary.head.append_column("loadings", lists(self.loadings.head)).select(["term", "idf", "loadings"]))
        near = self.posts.spark.createDataFrame(pa.table([pa.array(np.arange(len(self.loadings.head))), lists(self.loadings.head)], names=["place", "loadings"]))
        known = self.posts.vocabulary().join(near.unionByName(self.loadings.long()), "place")
        return self.posts.words.spelled(known).select("term", "idf", "loadings")

    def describe(self, top_words: int = 8) -> DataFrame:
        """``topic, label, top_words``: the words with the highest loadings, ties in alphabetical order."""
        rows = []
        for topic, loading in enumerate(self.loadings.head.T):
            least = np.partition(loading, -top_words)[-top_words] if len(loading) > top_words else -np.inf
            rows += [(topic, int(at), float(loading[at])) for at in np.flatnonzero(loading >= least)]
        spark = self.posts.x.sparkSession if isinstance(self.posts, Matrix) else self.posts.spark
        best = spark.createDataFrame(rows, "topic int, place long, loading double")
        if isinstance(self.posts, Matrix):
            names = self.vocabulary.head.column("term").to_pylist()
            best = spark.createDataFrame([(topic, value, names[at]) for topic, at, value in rows], "topic int, loading double, term string")
        else:
            far = self.loadings.long().select("place", F.posexplode("loadings").alias("topic", "loading"))
            # of each topic, only what reaches the last of its best frequent words
            least = F.broadcast(best.groupBy("topic").agg(F.min("loading").alias("least")))
            near = far.join(least, "topic").where(F.col("loading") >= F.col("least")).select("topic", "place", "loading")
            best = settle(best.unionByName(near), "best").join(self.posts.vocabulary().drop("idf"), "place")
            best = self.posts.words.spelled(settle(best, "best-keys"))
        rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("loading"), "term"))
        ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
        words = best.withColumn("rank", rank).where(F.col("rank") <= top_words).groupBy("topic").agg(
            F.transform(ordered, lambda word: word["term"]).alias("top_words"))
        return words.select(
            "topic", F.array_join(F.slice("top_words", 1, 3), " / ").alias("label"), "top_words").orderBy("topic")

    def weights(self, df: DataFrame | None = None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """Topic weights of the fitted posts, or of new ones: ``keep`` of the fit, or of ``df`` (all columns if None), plus ``weights``.

        The kept columns of new posts are written with their words, so a text that is not wanted should not be kept.
        """
        gram = self.loadings.sums(lambda h: h.T @ h)
        solve = lambda cross: least_squares_weights(cross, gram)
        if df is None:
            return self.posts.rows(self.loadings, solve)
        keep = df.columns if keep is None else list(keep)
        posts = _joined(df, text_col, keep)
        if isinstance(self.posts, TermBlocks):
            with shuffles_dropped(df.sparkSession):
                return self.posts.rows(self.loadings, solve, _coded(posts, self.posts.words, keep))
        return _matrix(posts, self.vocabulary, keep).rows(self.loadings, solve)

    def assign(self, df: DataFrame | None = None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """Adds ``topic``, the index of the largest weight; -1 where no topic has any weight."""
        best = F.array_max("weights")
        topic = F.when(best > 0, F.array_position("weights", best).cast("int") - 1).otherwise(F.lit(-1))
        return self.weights(df, text_col, keep).withColumn("topic", topic).drop("weights")


def _matrix(posts: DataFrame, words: Vocabulary, keep: Sequence[str]) -> Matrix:
    tokens = posts.select(*[F.col(f"`{c}`") for c in keep], F.filter(F.split("_words", " "), lambda word: word != "").alias("_tokens"))
    return Matrix(as_table(_weigh(tokens, words, keep), "weighted"), list(keep))


def fit_topics(
    df: DataFrame,
    n_topics: int = fixed.TOPICS,
    seed: int = fixed.SEED,
    text_col: str = "text",
    keep: Sequence[str] = ("post_id",),
    max_iter: int = 400,
    tolerance: float = LOSS_TOLERANCE,
    start_passes: int = START_PASSES,
    head_terms: int = HEAD_TERMS,
    piece: int = PIECE,
    head_words: int = HEAD_WORDS,
) -> TopicModel:
    """Fits one model over all posts of ``df``; the assignment of the posts carries the columns in ``keep``.

    It ends after ``max_iter`` passes, or when a pass gains no more than ``tolerance`` of what the first one gained.
    ``start_passes`` products find the singular vectors of the start.
    """
    with shuffles_dropped(df.sparkSession):
        return _fitted(df, n_topics, seed, text_col, list(keep), max_iter, tolerance, start_passes, head_terms, piece, head_words)


def _fitted(
    df: DataFrame, n_topics: int, seed: int, text_col: str, keep: list[str], max_iter: int, tolerance: float, start_passes: int,
    head_terms: int, piece: int, head_words: int,
) -> TopicModel:
    posts = _stored(_joined(df, text_col, keep))
    words = Words.of(_word_counts(posts, fixed.MIN_DOCUMENTS), head_words)
    blocks = TermBlocks(_coded(posts, words, keep), words, fixed.MIN_DOCUMENTS, fixed.MAX_DOCUMENT_SHARE, head_terms, piece)
    size, documents = blocks.terms.size, blocks.posts
    if not size:
        raise ValueError("no term is in two posts and in at most half of all posts")
    k = min(n_topics, max(1, size - 1), documents)
    if blocks.terms.tail:
        losses, h = _fit_blocks(blocks, documents, k, seed, max_iter, tolerance, start_passes)
        return TopicModel(h.columns, blocks, losses, KeyedVocabulary(blocks), h)
    known = Vocabulary(blocks.terms, words.spelled(blocks.vocabulary()).toArrow().sort_by("place").select(["term", "idf"]))
    x = _matrix(posts, known, keep)
    h, square = _start(x, known.terms, documents, k, seed, start_passes)
    losses: list[float] = []
    for _ in range(max_iter):
        gram = h.sums(lambda rows: rows.T @ rows)

        def normal_equations(z: np.ndarray, rows: SparseRows) -> tuple[np.ndarray, np.ndarray]:
            w = least_squares_weights(z, gram)
            return w, w.T @ w

        cross, outer = x.product(h, normal_equations, h.columns)
        outer = outer.reshape(h.columns, h.columns)
        losses.append(square - 2 * float(np.trace(cross.dot(h))) + float((outer * gram).sum()))
        if len(losses) > 2 and losses[-2] - losses[-1] <= tolerance * (losses[0] - losses[1]):
            break
        h = _unit_topics(cross.map(lambda rows: least_squares_weights(rows, outer)))
    return TopicModel(h.columns, x, losses, known, h)


def _unit_topics(h: Factor) -> Factor:
    """Topics of unit length; one that lost all its terms gets an even loading and may come back."""
    total, square = h.sums(lambda rows: np.stack([rows.sum(axis=0), (rows**2).sum(axis=0)]))
    dead = total <= 0
    if dead.any():
        h = h.map(lambda rows: np.where(dead, _TINY, rows))
        square = np.where(dead, h.terms.size * _TINY**2, square)
    return h.times(np.diag(1 / np.maximum(np.sqrt(square), _TINY)))


def _start(x: Matrix, terms: Terms, documents: int, k: int, seed: int, passes: int = START_PASSES) -> tuple[Factor, float]:
    """Non-negative start from the leading singular vectors, zeros filled with the mean weight; and |X|^2.

    The vectors come from a subspace iteration with a seeded random start. The last product also gives the
    eigenvectors of X'X inside the basis that it started from.
    """
    def multiply(z: np.ndarray, rows: SparseRows) -> tuple[np.ndarray, np.ndarray]:
        return z, np.array([rows.value.sum(), (rows.value**2).sum()])

    width = min(k + 5, terms.size)
    basis = _orthonormal(Factor.random(terms, width, seed))
    for step in range(passes):
        image, (total, square) = x.product(basis, multiply, basis.columns)
        if step < passes - 1:
            basis = _orthonormal(image)
    small = basis.dot(image)
    values, inner = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    right, singular = basis.times(inner[:, order]), np.sqrt(np.maximum(values[order], 0.0))

    # squared lengths of the positive and the negative part of X v, and of v
    positive, negative = x.product(right, lambda z, rows: (None, _sides(z)), 0)[1].reshape(2, -1)
    started = _started(singular, positive, negative, *right.sums(_sides), total / (documents * terms.size))
    return right.map(started), float(square)


def _sides(rows: np.ndarray) -> np.ndarray:
    """Squared lengths of the positive and of the negative part of each column."""
    return np.stack([(np.maximum(rows, 0) ** 2).sum(axis=0), (np.minimum(rows, 0) ** 2).sum(axis=0)])


def _started(singular: np.ndarray, positive: np.ndarray, negative: np.ndarray, above: np.ndarray, below: np.ndarray, mean: float) -> Callable:
    """What makes the start of rows of singular vectors."""
    # the stronger side of each pair of singular vectors; both sides of the first, which has one sign
    up, down = np.sqrt(positive * above), np.sqrt(negative * below)
    sign = np.where(up >= down, 1.0, -1.0)
    length = np.where(up >= down, up, down) / np.maximum(singular, _TINY)
    norm = np.sqrt(np.where(up >= down, above, below))
    length[0], norm[0] = 1.0, np.sqrt(above[0] + below[0])
    scale = np.sqrt(singular * length) / np.maximum(norm, _TINY)

    def started(v: np.ndarray) -> np.ndarray:
        part = np.maximum(v * sign, 0)
        part[:, 0] = np.abs(v[:, 0])
        part = part * scale
        return np.where(part <= _TINY, mean, part)

    return started


def _orthonormal(factor: Factor) -> Factor:
    """The columns as an orthonormal basis; directions without length are left out."""
    return factor.times(_whitening(factor.sums(lambda rows: rows.T @ rows)))


def _whitening(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    long = values > values.max() * 1e-12
    return vectors[:, long] / np.sqrt(values[long])


def _fit_blocks(x: TermBlocks, documents: int, k: int, seed: int, max_iter: int, tolerance: float, passes: int) -> tuple[list[float], Factor]:
    """The same fit for vocabularies beyond the head. A pass over the groups of terms makes H from W, uses it and returns
    X H' and H H'; the loss and the next W need no more than those."""
    def gram_of(rows: np.ndarray) -> np.ndarray:
        return rows.T @ rows

    size = x.terms.size
    total, square = x.measure()
    width = min(k + 5, size)
    basis = Derived(None, lambda places, _: normal_rows(seed, places, width))
    z, gram = x.project(basis, width, gram_of)
    m = _whitening(gram.reshape(width, width))
    for _ in range(passes - 1):
        left, _ = x.left(z, len(m), lambda y: (y @ m, np.zeros(1)))
        basis = Derived(left, lambda places, sums: sums)
        width = left.shape[1]
        z, gram = x.project(basis, width, gram_of)
        m = _whitening(gram.reshape(width, width))
    _, small = x.left(z, width, lambda y: (None, gram_of(y @ m)))
    values, inner = np.linalg.eigh(small.reshape(m.shape[1], -1))
    order = np.argsort(values)[::-1][:k]
    right, singular = m @ inner[:, order], np.sqrt(np.maximum(values[order], 0.0))
    _, parts = x.left(z, width, lambda y: (None, _sides(y @ right)))
    _, sides = x.project(basis, width, lambda rows: _sides(rows @ right), product=False)
    started = _started(singular, *parts.reshape(2, -1), *sides.reshape(2, -1), total / (documents * size))
    vectors = basis.change
    h, k = Derived(basis.left, lambda places, sums: started(vectors(places, sums) @ right)), len(singular)
    z, gram = x.project(h, k, gram_of)
    gram, scale = gram.reshape(k, k), np.eye(k)
    losses: list[float] = []
    for _ in range(max_iter):
        def solve(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cross = y @ scale
            w = least_squares_weights(cross, gram)
            return w, np.append(w.T @ w, (w * cross).sum())

        w, sums = x.left(z, k, solve)
        outer = sums[:-1].reshape(k, k)
        losses.append(square - 2 * float(sums[-1]) + float((outer * gram).sum()))
        if len(losses) > 2 and losses[-2] - losses[-1] <= tolerance * (losses[0] - losses[1]):
            break
        h, z, (total_of, square_of, gram) = _next_rows(x, w, outer, np.zeros(k, bool))
        if (total_of <= 0).any():  # one that lost all its terms gets an even loading and may come back
            h, z, (total_of, square_of, gram) = _next_rows(x, w, outer, total_of <= 0)
        scale = np.diag(1 / np.maximum(np.sqrt(square_of), _TINY))
        gram = scale @ gram @ scale
    return losses, x.factor(h, scale, z)


def _next_rows(x: TermBlocks, w: np.ndarray, outer: np.ndarray, dead: np.ndarray) -> tuple[Derived, DataFrame, tuple]:
    """H for the weights ``w``, X H', and the sums, squared lengths and products of its topics."""
    k = len(outer)

    def change(places: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.where(dead, _TINY, least_squares_weights(sums, outer))

    h = Derived(w, change)
    z, sums = x.project(h, k, lambda rows: np.concatenate([[rows.sum(axis=0)], [(rows**2).sum(axis=0)], rows.T @ rows]))
    sums = sums.reshape(k + 2, k)
    return h, z, (sums[0], sums[1], sums[2:])
