"""Sentiment scorers. Each adds ``sentiment``, ``compound`` and ``status`` to a frame of posts.

``status`` is ``ok`` or ``error``. A failed post keeps null sentiment; it is counted and left out of every
statistic, never turned into a label.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed_values as fixed
from ..functions.sentiment import label_from_compound, lexicon_compound, normalize_label
from ..storage import placed

SCORE_FIELDS = "sentiment string, compound double, status string"
SCORE_NAMES = ("sentiment", "compound", "status")
#: posts of a range, but for those that share a key; batches after its end where the next range may begin
RANGE_POSTS, BORDER_BATCHES = 20_000, 64
_SCORE_SCHEMA = pa.schema([("sentiment", pa.string()), ("compound", pa.float64()), ("status", pa.string())])


class Scorer(Protocol):
    name: str

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame: ...


class LexiconScorer:
    """Built-in expressions only; other lexicons may be given."""

    name = "lexicon"

    def __init__(self, valence=fixed.VALENCE, negators=fixed.NEGATORS, intensifiers=fixed.INTENSIFIERS):
        self.resources = (valence, negators, intensifiers)

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return _labelled(df.withColumn("compound", lexicon_compound(F.col(text_col), *self.resources)))


def _labelled(df: DataFrame) -> DataFrame:
    return df.withColumns({"sentiment": label_from_compound(F.col("compound")), "status": F.lit("ok")})


def _vader() -> Callable[[str], float]:
    try:
        from vaderSentiment.vaderSentiment import SentimentIntensityAnalyzer
    except ImportError as missing:
        raise ImportError("the vader scorer needs the package vaderSentiment on every executor") from missing
    analyzer = SentimentIntensityAnalyzer()
    return lambda text: analyzer.polarity_scores(text)["compound"]


class AnalyzerScorer:
    """Adapter for a rule analyzer: ``make`` builds, once per task, a function from a text to its compound."""

    name = "vader"

    def __init__(self, make: Callable[[], Callable[[str], float]] = _vader):
        if make is _vader:
            make()  # fails here, not in a task, where the package is absent
        self.make = make

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        make = self.make

        @F.pandas_udf("double")
        def compound(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            analyze = make()
            for texts in batches:
                yield pd.Series([analyze(str(text)) for text in texts], dtype="float64")

        return _labelled(df.withColumn("compound", compound.asNondeterministic()(F.col(text_col))))


def _borders(posts: DataFrame, keys: list[str], size: int) -> tuple[list[tuple], int]:
    """Keys of posts that begin a batch and differ from the post before, about a range apart; and the posts of the longest range."""
    columns = [F.col(f"`{key}`") for key in keys]
    numbered = placed(posts.select(*columns), "order", *columns)
    total = numbered.count()
    tasks = 2 * posts.sparkSession.sparkContext.defaultParallelism
    per = max(1, -(-min(RANGE_POSTS, -(-total // tasks)) // size))  # batches of a range
    key = F.struct(*columns)
    begins = numbered.where(F.col("place") % size == 0).select(F.floor(F.col("place") / size).alias("b"), key.alias("at"), F.lit(None).alias("before"))
    ends = numbered.where(F.col("place") % size == size - 1).select(F.floor(F.col("place") / size + 1).alias("b"), F.lit(None).alias("at"), key.alias("before"))
    near = (F.col("b") >= per) & (F.col("b") % per < BORDER_BATCHES)
    both = begins.where(near).unionByName(ends.where(near)).groupBy("b").agg(
        F.first("at", ignorenulls=True).alias("at"), F.first("before", ignorenulls=True).alias("before"))
    apart = both.where(F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("before")))
    found = apart.groupBy(F.floor(F.col("b") / per).alias("range")).agg(F.min("b").alias("b"), F.min_by("at", "b").alias("at")).toArrow().sort_by("b")
    starts = found.column("b").to_numpy() * size
    return [_sortable(at.values()) for at in found.column("at").to_pylist()], int(np.diff(starts, prepend=0, append=total).max())


def _sortable(values) -> tuple:
    """A key in the order of Spark, which has nulls first."""
    return tuple((value is not None, value) for value in values)


def _in_ranges(posts: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The posts in ranges of (id, text), each with whole batches, in the column ``_range`` and in order within.

    Ids alone are sorted to find where ranges begin, so texts move once; only where many posts share an id are texts sorted too.
    """
    keys = [id_col]
    borders, longest = _borders(posts, keys, size)
    if longest > 4 * max(RANGE_POSTS, size):
        keys = [id_col, text_col]
        borders, _ = _borders(posts, keys, size)

    @F.arrow_udf("int")
    def range_of(*columns: pa.Array) -> pa.Array:
        return pa.array([bisect_right(borders, _sortable(values)) for values in zip(*[c.to_pylist() for c in columns])], pa.int32())

    dealt = posts.withColumn("_range", range_of(*[F.col(f"`{key}`") for key in keys])).repartitionById(len(borders) + 1, F.col("_range"))
    return dealt.sortWithinPartitions("_range", F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted ranges with ``_batch`` for ``_range``; every ``size`` posts of a range are a batch."""
    now, seen = -1, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        of = rows.column("_range").to_numpy().astype(np.int64)
        at = np.arange(len(of))
        place = at - np.maximum.accumulate(np.where(np.diff(of, prepend=now) != 0, at, -seen))
        now, seen = int(of[-1]), int(place[-1]) + 1
        yield rows.drop_columns(["_range"]).append_column("_batch", pa.array((of << 40) + place // size))


class ModelScorer:
    """Batched model. ``load`` builds, once per task, a function from texts to class probabilities.

    ``labels`` are the model's own class names. Posts are numbered in the order of their ids, and each ``batch_size`` of
    them are one batch, formed before the model runs: which posts share a batch, and so fail with it, does not depend on
    the partitioning. The posts of a batch that fails have status ``error`` and the run goes on. A stream, or a frame
    without ids, is scored in batches of posts as they come.
    """

    name = "transformer"

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], labels: Sequence[str], batch_size: int = 64):
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        self.load, self.batch_size = load, batch_size
        self.labels = [normalize_label(label) for label in labels]

    def _classifier(self) -> Callable[[Callable, Sequence[str]], pd.DataFrame]:
        labels = np.array(self.labels, dtype=object)
        at = {label: index for index, label in enumerate(self.labels)}

        def classify(model: Callable[[list[str]], np.ndarray], texts: Sequence[str]) -> pd.DataFrame:
            try:
                chances = np.asarray(model([str(text) for text in texts]), dtype=float).reshape(len(texts), len(labels))
            except Exception:  # one bad batch must not end the run
                return pd.DataFrame({"sentiment": [None] * len(texts), "compound": np.nan, "status": "error"})
            zeros = np.zeros(len(texts))
            side = {name: chances[:, at[name]] if name in at else zeros for name in ("positive", "negative")}
            return pd.DataFrame({"sentiment": labels[chances.argmax(axis=1)],
                                 "compound": side["positive"] - side["negative"], "status": "ok"})

        return classify

    def score(self, df: DataFrame, text_col: str = "text", id_col: str = "post_id") -> DataFrame:
        if df.isStreaming or id_col not in df.columns:
            return self._score_as_they_come(df, text_col)
        load, classify, size = self.load, self._classifier(), self.batch_size
        posts = df.drop(*SCORE_NAMES)
        names = posts.columns
        dealt = _in_ranges(posts, id_col, text_col, size)

        def scored(model: Callable, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            number = rows.column("_batch").to_numpy()
            edges = [*np.flatnonzero(np.diff(number, prepend=-1)), len(number)]
            found = [classify(model, rows.column(text_col)[a:b].to_pylist()) for a, b in zip(edges, edges[1:])]
            score = pa.Table.from_pandas(pd.concat(found), schema=_SCORE_SCHEMA, preserve_index=False)
            out = rows.select(names)
            for name in SCORE_NAMES:
                out = out.append_column(name, score.column(name))
            yield from out.combine_chunks().to_batches()

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, held = load(), None
            for batch in _numbered(batches, size):
                rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                # the last batch may go on in the next rows
                number = rows.column("_batch").to_numpy()
                whole = int(np.searchsorted(number, number[-1]))
                held = rows.slice(whole)
                if whole:
                    yield from scored(model, rows.slice(0, whole))
            if held is not None and held.num_rows:
                yield from scored(model, held)

        fields = StructType([dealt.schema[name] for name in names])
        for name, kind in zip(SCORE_NAMES, ("string", "double", "string")):
            fields = fields.add(name, kind)
        done = dealt.mapInArrow(predict, fields)
        return done.withColumn("compound", F.when(F.col("status") == "ok", F.col("compound")))

    def _score_as_they_come(self, df: DataFrame, text_col: str) -> DataFrame:
        load, classify, size = self.load, self._classifier(), self.batch_size

        # only the text travels to Python; not deterministic, so that no filter runs the model a second time
        @F.pandas_udf(SCORE_FIELDS)
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                yield pd.concat([classify(model, texts.iloc[i:i + size]) for i in range(0, len(texts), size)])

        scored = df.withColumn("_score", predict.asNondeterministic()(F.col(text_col)))
        return scored.withColumns({
            "sentiment": F.col("_score.sentiment"),
            "compound": F.when(F.col("_score.status") == "ok", F.col("_score.compound")),
            "status": F.col("_score.status"),
        }).drop("_score")


SCORERS: dict[str, type] = {"lexicon": LexiconScorer, "vader": AnalyzerScorer, "transformer": ModelScorer}


def build_scorer(name: str, **options) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known are {', '.join(SCORERS)}")
    return SCORERS[name](**options)


def error_counts(scored: DataFrame) -> DataFrame:
    """Posts per period that have no score."""
    return scored.filter(F.col("status") != "ok").groupBy("period").agg(F.count("*").alias("errors"))


def without_errors(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("status") == "ok")
