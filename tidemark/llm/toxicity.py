"""Toxicity by weak supervision.

Voters say "toxic" or nothing about a text: every entry of fixed lexicons, text patterns, and stems that the labelled
rows bring up (words and word heads that are far more frequent in texts labelled toxic). A generative label model
takes the true label as hidden, starts from the number of votes a text has, estimates by expectation maximization how
often each voter fires under either label, and shares the weight of voters that still fire together once the label is
known; the given label is one more voter, with rates of its own like all others. A linear classifier is then trained on
the posterior labels, over counts of all stems. A score needs the classifier alone: no voter runs for it.

Counts for the choice of stems, the label model and the classifier come from a bounded sample of labelled rows
(``SAMPLE`` per label, chosen by a hash of the id). Every text is then scored whole, in one pass without exchange.
Only the text enters a score.

Defined results: null and empty texts get the score of a text without any stem; a null id is not held out and has no
label; repeated rows are scored as rows; labels other than 0 and 1 are ignored, as is everything but the least label
of an id; without labels of both kinds the fixed voters decide; an empty table gives an empty table; other columns
of the input are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import as_table

#: labelled rows of either label that are learnt from
SAMPLE = 8_000
#: stems of the classifier, and stems that vote
STEMS, STEM_VOTERS = 20_000, 400
HEADS = (3, 4, 5, 6, 7)

#: fixed values: words of abuse in the four languages
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers worthless pathetic disgusting scum trash garbage clown clowns "
    "fool fools imbecile jerk bastard bitch asshole shit fuck fucking damn crap filthy vermin ugly hate kill "
    "dumm dumme dummkopf trottel depp deppen blöd blödmann arsch arschloch scheiße scheisse mist abschaum dreck "
    "wertlos erbärmlich widerlich versager hurensohn schlampe "
    "crétin crétins imbécile connard connasse salaud salope merde débile nul nulle minable ordure raclure pourriture "
    "dégoûtant pathétique "
    "idiota idiotas estúpido estúpida imbécil tonto tonta basura escoria patético patética asqueroso asquerosa "
    "mierda cabrón perdedor inútil payaso".split())
#: fixed values: text patterns, each one voter
PATTERNS = (
    ("second_person", r"\b(?:you|your)\s+(?:are\s+)?(?:an?\s+|such\s+an?\s+)?(?:idiot|moron|loser|fool|clown|pathetic|stupid|worthless|disgusting)"),
    ("this_kind", r"\b(?:this|that|these)\s+(?:idiot|moron|loser|clown|scum|trash)"),
    ("masked", r"\b[a-z][*@#]{2,}[a-z]*\b"),
    ("shut_up", r"\b(?:shut up|get lost|go away|halt die klappe|ta gueule|ferme-la|cállate)\b"),
)
_WORDS = re.compile(r"[^\W\d_]+").findall
_CHECKS = [re.compile(p, re.I).search for _, p in PATTERNS]
_ENTRY = {word: i for i, word in enumerate(sorted(LEXICON))}


def word_counts(text: str) -> Counter:
    return Counter(_WORDS(text.lower()))


def stems_of(word: str) -> list[str]:
    """The word itself, marked, and its heads."""
    return ["=" + word, *(word[:n] for n in HEADS if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, toxic: up to ``per_label`` rows of each label, none held out."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    one = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for t in (0, 1)]
    return as_table(one[0].unionByName(one[1]), "toxic-sample")


def stem_counts(train: DataFrame) -> DataFrame:
    """stem, in_toxic, in_other: labelled texts that hold a stem. Every task adds up what it has read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def send() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())],
                ["stem", "in_toxic", "in_other"])

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[toxic].update({s for w in word_counts(text.as_py() or "") for s in stems_of(w)})
                if len(held[0]) + len(held[1]) > 500_000:
                    yield send()
                    held = (Counter(), Counter())
        if held[0] or held[1]:
            yield send()

    return train.select("toxic", "text").mapInArrow(count, "stem string, in_toxic long, in_other long").groupBy("stem").agg(
        F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))


def choose_stems(counts: DataFrame, n_toxic: int, n_other: int, at_most: int = STEMS) -> list[tuple[str, float, int, int]]:
    """The stems that differ most between the labels: (stem, log odds, in_toxic, in_other), best first."""
    p = (F.col("in_toxic") + 0.5) / (n_toxic + 1.0)
    q = (F.col("in_other") + 0.5) / (n_other + 1.0)
    spread = F.sqrt(1 / (F.col("in_toxic") + 0.5) + 1 / (F.col("in_other") + 0.5))
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    chosen = counts.where("in_toxic >= 3").select("stem", odds.alias("odds"), (odds / spread).alias("z"), "in_toxic", "in_other").where(
        "z > 2").orderBy(F.desc("z"), "stem").limit(at_most)
    return [(r.stem, r.odds, r.in_toxic, r.in_other) for r in chosen.toLocalIterator()]


class Reader:
    """Counts of stems of a text, and the words that its scores take from the lists of voters."""

    def __init__(self, stems: dict[str, int], voters: dict[str, int]):
        self.stems, self.voters, self.known = stems, voters, {}

    def of_word(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...], bool]:
        hits = self.known.get(word)
        if hits is None:
            if len(self.known) > 300_000:
                self.known.clear()
            names = stems_of(word)
            hits = self.known[word] = (
                tuple(self.stems[s] for s in names if s in self.stems),
                tuple(self.voters[s] for s in names if s in self.voters), word in LEXICON)
        return hits

    def __call__(self, words: Counter) -> tuple[dict[int, int], int, int, int]:
        """Stem counts, lexicon words, words under a stem that votes, words."""
        counts: dict[int, int] = {}
        lexicon = voted = 0
        for word, n in words.items():
            stems, voters, listed = self.of_word(word)
            for s in stems:
                counts[s] = counts.get(s, 0) + n
            if voters:
                voted += n
            lexicon += n * listed
        return counts, lexicon, voted, words.total()

    def votes(self, text: str, words: Counter) -> list[int]:
        """The voters that fire: stems, then patterns, then the entries of the lexicon."""
        found = {v for word in words for v in self.of_word(word)[1]}
        base = len(self.voters)
        found.update(base + i for i, check in enumerate(_CHECKS) if check(text))
        base += len(_CHECKS)
        found.update(base + _ENTRY[word] for word in words if word in _ENTRY)
        return sorted(found)


def label_model(votes: np.ndarray, steps: int = 100) -> np.ndarray:
    """Posterior probability of "toxic" per text.

    ``votes`` is texts by voters, 0 or 1, the last one being the given label. The firing rates of all voters under either
    label and the share of toxic texts are estimated from the votes, starting from the texts for which a word, stem or
    pattern votes. Voters that fire together more than their rates explain share their weight: a voter counts
    1 / (1 + sum of its remaining correlations). The given label comes from no word, so it shares none; how much it
    counts is what its rates say.
    """
    x = votes.astype(np.float32)
    q = np.where(x[:, :-1].any(axis=1), 0.9, 0.1).astype(np.float32)
    share = np.ones(x.shape[1], np.float32)
    for step in range(steps):
        prior = float(np.clip(q.mean(), 0.01, 0.99))
        on = (q @ x + 0.5) / (q.sum() + 1)
        off = ((1 - q) @ x + 0.5) / ((1 - q).sum() + 1)
        if step % 10 == 5:
            rest = x - (q[:, None] * on + (1 - q)[:, None] * off).astype(np.float32)
            together = (rest.T @ rest).astype(np.float64)
            scale = np.sqrt(np.diag(together) + 1e-9)
            together = np.clip(together / (scale[:, None] * scale[None, :]), 0, 1)
            np.fill_diagonal(together, 0)
            together[-1], together[:, -1] = 0, 0
            share = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=1))
        weight = share * (np.log(on / off) - np.log((1 - on) / (1 - off)))
        bias = (share * np.log((1 - on) / (1 - off))).sum() + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(x @ weight + bias, -30, 30)))
        if step > 6 and np.abs(new - q).max() < 1e-6:
            return new
        q = new
    return q


def dense(lexicon: int, voted: int, words: int) -> tuple[float, ...]:
    """What a score takes from a text besides its stems."""
    n = max(words, 1)
    return (float(np.log1p(lexicon)), float(np.log1p(voted)), min(1.0, 10 * lexicon / n), min(1.0, 10 * voted / n), 1.0)


#: weights of ``dense`` before any label is seen
START = np.array([2.0, 0.0, 1.0, 0.0, -3.0])


def fit_linear(at: np.ndarray, stem: np.ndarray, count: np.ndarray, extra: np.ndarray, target: np.ndarray, case: np.ndarray,
               n_stems: int, ridge: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the stems and of ``dense``: logistic loss against soft targets, by Adam over all rows.

    The counts are a sparse table: text ``at[k]`` holds ``stem[k]`` ``count[k]`` times.
    """
    value = np.log1p(count.astype(np.float64))
    n_rows = len(target)
    w, d = np.zeros(n_stems), START.copy()
    moment = [np.zeros(n_stems), np.zeros(len(d))], [np.zeros(n_stems), np.zeros(len(d))]
    case = case / case.sum()
    for step in range(1, steps + 1):
        z = np.bincount(at, weights=value * w[stem], minlength=n_rows) + extra @ d
        g = case * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grads = np.bincount(stem, weights=value * g[at], minlength=n_stems) + ridge * w, extra.T @ g + ridge * (d - START)
        rate = 0.05 * (1 - step / (steps + 1))
        for k, (p, grad) in enumerate(zip((w, d), grads)):
            moment[0][k][:] = 0.9 * moment[0][k] + 0.1 * grad
            moment[1][k][:] = 0.999 * moment[1][k] + 0.001 * grad * grad
            p -= rate * (moment[0][k] / (1 - 0.9**step)) / (np.sqrt(moment[1][k] / (1 - 0.999**step)) + 1e-8)
    return w, d


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[dict[str, int], dict[str, int], np.ndarray, np.ndarray]:
    """Stems, voters, stem weights and dense weights."""
    sample = sample_labels(labels, per_label)
    labelled = as_table(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), "toxic-train")
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return {}, {}, np.zeros(0), START
    chosen = choose_stems(stem_counts(labelled), n_toxic, n_other)
    stems = {s: i for i, (s, *_) in enumerate(chosen)}
    sure = [s for s, _, a, b in chosen if a >= 5 and a * n_other >= 9 * (b + 0.5) * n_toxic][:STEM_VOTERS]
    voters = {s: i for i, s in enumerate(sure)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems, voters)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            words = [word_counts(t) for t in texts]
            rows = [reader(w) for w in words]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([list(c.keys()) for c, *_ in rows], pa.list_(pa.int32())),
                pa.array([list(c.values()) for c, *_ in rows], pa.list_(pa.int32())),
                pa.array([reader.votes(t, w) for t, w in zip(texts, words)], pa.list_(pa.int32())),
                pa.array([list(dense(*r)) for _, *r in rows], pa.list_(pa.float64()))],
                ["toxic", "stems", "counts", "votes", "extra"])

    table = labelled.select("toxic", "text").mapInArrow(
        read, "toxic int, stems array<int>, counts array<int>, votes array<int>, extra array<double>").toArrow()
    given = table["toxic"].to_numpy()

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table[name].combine_chunks()
        return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()

    votes = np.zeros((len(given), len(voters) + len(PATTERNS) + len(LEXICON) + 1), np.uint8)
    votes[flat("votes")] = 1
    votes[:, -1] = given
    posterior = label_model(votes)
    # rows weigh as their label is frequent among the rows that may be learnt from
    total = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    case = np.where(given == 1, total / n_toxic, (1 - total) / n_other)
    at, stem = flat("stems")
    extra = flat("extra")[1].reshape(len(given), -1)
    return stems, voters, *fit_linear(at, stem, flat("counts")[1], extra, posterior, case, len(stems))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", per_label: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words of every row of ``docs``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = train(rows, labels, per_label)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, voters, weights, base = sent.value
        reader = Reader(stems, voters)
        for batch in batches:
            scores, sizes = [], []
            for value in batch.column(2):
                counts, *rest = reader(word_counts(value.as_py() or ""))
                z = float(np.dot(base, dense(*rest)))
                if counts:
                    z += float(np.dot(weights[list(counts)], np.log1p(list(counts.values()))))
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                sizes.append(rest[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(sizes, pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_words"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        read, "doc_id long, held_out boolean, score double, predicted int, n_words long")
