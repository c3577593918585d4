from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import topics

FOUR = ["vote policy budget", "vote campaign polls", "goal derby season", "goal penalty season"] * 10


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(str(i), t, "pre" if i % 2 else "post") for i, t in enumerate(FOUR)],
                                 "post_id string, text string, period string")


def test_tokens_and_pairs(one):
    assert one(topics.vocabulary_tokens, "It's the rock'n'roll new POLICY") == ["it", "rock", "roll", "new", "policy"]
    assert one(lambda c: topics.words_and_pairs(topics.vocabulary_tokens(c)), "new policy vote") == [
        "new", "policy", "vote", "new policy", "policy vote"]
    assert one(lambda c: topics.words_and_pairs(topics.vocabulary_tokens(c)), "new") == ["new"]
    assert one(lambda c: topics.words_and_pairs(topics.vocabulary_tokens(c)), "a") == []


def test_entries_of_a_batch():
    batch = pa.record_batch([pa.array([["b", "a", "b", "c", "b", "a"], [], ["c"]])], names=["_tokens"])
    names, row, term, n = topics._entries(batch)
    got = {(int(r), names[int(t)].as_py()): int(k) for r, t, k in zip(row, term, n)}
    assert got == {(0, "a"): 2, (0, "b"): 3, (0, "c"): 1, (0, "b a"): 2, (0, "a b"): 1, (0, "b c"): 1, (0, "c b"): 1, (2, "c"): 1}


def test_batches_are_cut_by_their_words():
    batch = pa.record_batch([pa.array([["a", "b"], [], ["b", "c", "b"], ["d"] * 9, ["a"], ["a", "c"]])], names=["_tokens"]).slice(1)
    parts = list(topics._sliced(iter([batch, batch.slice(0, 0)]), "_tokens", 4))
    assert [p.column(0).to_pylist() for p in parts] == [[[], ["b", "c", "b"], ["d"] * 9], [["a"], ["a", "c"]]]
    counted = {}
    for part in parts:
        names, _, which, _ = topics._entries(part)
        for at in which:
            counted[names[int(at)].as_py()] = counted.get(names[int(at)].as_py(), 0) + 1
    assert counted == {"b": 1, "c": 2, "b c": 1, "c b": 1, "d": 1, "d d": 1, "a": 2, "a c": 1}
    packed = pa.record_batch([topics.as_bytes(np.arange(10), np.array([0, 4, 4, 9, 10]))], names=["terms"])
    assert [p.num_rows for p in topics._sliced(iter([packed]), "terms", 4, 8)] == [1, 2, 1]


def plain_tfidf(texts):
    from collections import Counter

    docs = []
    for t in texts:
        words = t.split()
        docs.append(Counter(words + [" ".join(p) for p in zip(words, words[1:])]))
    df = Counter(term for d in docs for term in d)
    n = len(docs)
    rows = []
    for d in docs:
        w = {t: (1 + np.log(c)) * (np.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items() if 2 <= df[t] <= 0.5 * n}
        norm = np.sqrt(sum(v * v for v in w.values()))
        rows.append({t: v / norm for t, v in w.items()})
    return rows


#: a head of eight terms, so that most terms are rare ones
SMALL = {"head_terms": 8, "piece": 4}


@pytest.mark.parametrize("sizes", [{}, SMALL], ids=["head", "tail"])
def test_tfidf_agrees_with_restatement(spark, sizes):
    texts = ["apple apple pear plum", "apple pear", "plum plum plum kiwi", "kiwi pear", "unseen words", "melon", "", "fig date fig date", "fig date lime", "lime nut"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, text string")
    want = plain_tfidf(texts)
    long = topics.tfidf(df, **sizes).collect()
    assert len(long) == sum(map(len, want))
    assert {(r.post_id, r.term): pytest.approx(r.weight) for r in long} == {(str(i), t): v for i, row in enumerate(want) for t, v in row.items()}
    model = topics.fit_topics(df, n_topics=2, **sizes)
    known = model.vocabulary
    assert (known.tail is not None) == bool(sizes)
    names = dict(enumerate(known.head.column("term").to_pylist())) | ({r.place: r.term for r in known.tail.collect()} if sizes else {})
    assert sorted(names) == list(range(known.terms.size)) and set(names.values()) == {t for row in want for t in row}
    assert {r.term for r in model.factors.collect()} == set(names.values())
    for row in model.posts.x.collect():
        terms, weights = np.frombuffer(row.terms, np.int64), np.frombuffer(row.weights)
        assert {names[t]: pytest.approx(w) for t, w in zip(terms, weights)} == want[int(row.post_id)]


@pytest.mark.parametrize("head_terms", [10_000, 5])
def test_terms_reach_the_posts_as_numbers(spark, head_terms):
    """Before, posts were tables of lists of words, and all but the most frequent terms met the posts as strings in a join."""
    rng = np.random.default_rng(2)
    words = np.array([a + b + c for a in "abcdefgh" for b in "klmpqr" for c in "xyz"])
    texts = [" ".join(words[np.minimum(rng.geometric(0.05, rng.integers(0, 40)) - 1, len(words) - 1)]) for _ in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, text string").repartition(5)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    long = topics.tfidf(df, head_terms=head_terms)
    got = {(r.post_id, r.term): r.weight for r in long.collect()}
    made = [d for d in folder.iterdir() if d not in before]
    lists = [d.name for d in made if "array<string>" in str(spark.read.parquet(str(d)).dtypes) or "term:string" in str(spark.read.parquet(str(d)).dtypes)]
    assert made and not lists
    want = {(str(i), t): v for i, row in enumerate(plain_tfidf(texts)) for t, v in row.items()}
    assert len(want) > 3_000 and got == {k: pytest.approx(v) for k, v in want.items()}
    assert long.count() == len(want)


@pytest.mark.parametrize("sizes", [{}, SMALL], ids=["head", "tail"])
def test_posts_that_share_an_id_keep_their_own_weights(spark, sizes):
    texts = ["blue red", "blue green", "red pink", "green pink", "grey", "black"]
    rows = [("same" if i < 2 else str(i), t) for i, t in enumerate(texts)]
    got = sorted((r.term, r.weight) for r in topics.tfidf(spark.createDataFrame(rows, "post_id string, text string"), **sizes).collect() if r.post_id == "same")
    want = sorted((t, pytest.approx(v)) for row in plain_tfidf(texts)[:2] for t, v in row.items())
    assert got == want and len(got) == 4


@pytest.mark.parametrize("sizes", [{}, SMALL], ids=["head", "tail"])
def test_same_vocabulary_same_topic(spark, posts, sizes):
    model = topics.fit_topics(posts, n_topics=2, seed=1, keep=["post_id", "period"], **sizes)
    got = {int(r.post_id): r.topic for r in model.assign().collect()}
    assert got[0] == got[1] != got[2] == got[3] and set(got.values()) == {0, 1} and len(got) == 40
    words = model.describe(3).collect()
    assert [r.topic for r in words] == [0, 1] and all(len(r.top_words) == 3 and r.label.count(" / ") == 2 for r in words)
    new = spark.createDataFrame([("a", "budget vote"), ("b", "season goal"), ("c", "nothing known")], "id string, text string")
    fresh = {r.id: r.topic for r in model.assign(new).collect()}
    assert fresh == {"a": got[0], "b": got[2], "c": -1}
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))


@pytest.fixture(scope="module")
def corpus(spark):
    """Three kinds of posts over some 5,000 words and pairs."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = sorted({"".join(rng.choice(letters, 6)) for _ in range(1_500)})
    texts = []
    for i in range(900):
        share = np.exp(-np.arange(500) / (60.0 + 30 * (i % 3)))
        texts.append((str(i), " ".join(words[(i % 3) * 500 + j] for j in rng.choice(500, 20, p=share / share.sum())) + " " + " ".join(
            "common" + words[j] for j in rng.choice(60, 5))))
    return spark.createDataFrame(texts, "post_id string, text string")


def dense(model):
    """X of a model whose terms are all in the head."""
    rows = model.posts.x.collect()
    x = np.zeros((len(rows), model.vocabulary.terms.size))
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row.terms, np.int64)] = np.frombuffer(row.weights)
    return x


def dense_start(x, k):
    u, s, v = np.linalg.svd(x, full_matrices=False)
    h = np.zeros((k, x.shape[1]))
    h[0] = np.sqrt(s[0]) * np.abs(v[0])
    for j in range(1, k):
        sides = [(np.maximum(c * u[:, j], 0), np.maximum(c * v[j], 0)) for c in (1, -1)]
        a, b = max(sides, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        h[j] = np.sqrt(s[j] * np.linalg.norm(a) * np.linalg.norm(b)) * b / np.linalg.norm(b)
    h[h <= 1e-12] = x.mean()
    return h


def test_start_over_all_terms_is_the_dense_one(spark, corpus):
    model = topics.fit_topics(corpus, n_topics=3, max_iter=1)
    x = dense(model)
    assert x.shape[1] > 2_500
    h, square = topics._start(model.posts, model.vocabulary.terms, len(x), 3, 7, passes=12)
    expected = dense_start(x, 3)
    assert square == pytest.approx((x**2).sum())
    # where a singular vector is zero but for its last digits, either side may be filled with the mean
    assert np.mean(np.abs(h.head.T - expected) > 1e-6) < 0.01
    w = topics.least_squares_weights(x @ expected.T, expected @ expected.T)
    loss = ((x - w @ expected) ** 2).sum()
    assert topics.fit_topics(corpus, n_topics=3, max_iter=1, start_passes=12).losses[0] == pytest.approx(loss, rel=1e-6)


def test_equal_models_with_any_head(spark, corpus):
    whole = topics.fit_topics(corpus, n_topics=3, max_iter=6, tolerance=0, piece=128)
    small = topics.fit_topics(corpus, n_topics=3, max_iter=6, tolerance=0, head_terms=256, piece=128)
    assert small.vocabulary.tail is not None and whole.vocabulary.tail is None
    assert small.losses == pytest.approx(whole.losses, rel=1e-9)
    assert [r.top_words for r in small.describe().collect()] == [r.top_words for r in whole.describe().collect()]
    topic_of = [{r.post_id: r.topic for r in m.assign().collect()} for m in (whole, small)]
    assert topic_of[0] == topic_of[1] and len({topic_of[0][str(i)] for i in range(3)}) == 3
    again = {r.post_id: r.topic for r in small.assign(corpus).collect()}
    assert again == topic_of[0]


def test_the_fit_ends_by_the_gain_of_the_first_pass(spark, corpus):
    assert len(topics.fit_topics(corpus, n_topics=3, tolerance=1.0).losses) == 3
    losses = topics.fit_topics(corpus, n_topics=3, tolerance=1e-2).losses
    gains = -np.diff(losses)
    assert gains[-1] <= 1e-2 * gains[0] and (gains[:-1] > 1e-2 * gains[0]).all()


@pytest.mark.parametrize("tail", [False, True])
def test_lost_topics_are_revived_and_scaled(spark, tail):
    from tidemark.operators import term_factor

    h = np.array([[3.0, 0.0, 4.0], [0.0, 0.0, 0.0]]).T
    if tail:
        terms = term_factor.Terms(3, 2, 2)
        rest = spark.createDataFrame([(1, b"", bytearray(h[2:].tobytes()))], "piece long, ids binary, rows binary")
        factor = term_factor.Factor(terms, h[:2], rest, np.eye(2))
    else:
        factor = term_factor.Factor(term_factor.Terms(3), h, None, np.eye(2))
    got = topics._unit_topics(factor)
    assert np.allclose(got.sums(lambda r: r.T @ r), [[1, 1.4 * 3**-0.5], [1.4 * 3**-0.5, 1]])
    assert np.allclose(got.sums(lambda r: r.sum(axis=0)), [1.4, 3**0.5])


def test_no_vocabulary(spark):
    with pytest.raises(ValueError):
        topics.fit_topics(spark.createDataFrame([("1", "alpha"), ("2", "beta")], "post_id string, text string"))


def test_least_squares_weights_are_optimal():
    rng = np.random.default_rng(0)
    h, x = rng.random((3, 20)), rng.random((50, 20))
    w = topics.least_squares_weights(x @ h.T, h @ h.T)
    gradient = w @ (h @ h.T) - x @ h.T
    assert (w >= 0).all() and np.abs(gradient[w > 1e-9]).max() < 1e-6 and gradient[w <= 1e-9].min() > -1e-6


def test_passes_beyond_the_head_store_no_factor(spark, corpus):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    model = topics.fit_topics(corpus, n_topics=3, max_iter=4, tolerance=0, head_terms=256, piece=128)
    new = sorted(name.split("-")[1] for name in set(os.listdir(folder)) - before if name.startswith("tidemark-"))
    # H is written once, at the end; a pass leaves the product of the posts alone
    assert len(model.losses) == 4 and new.count("factor") == 1 and not {"sums", "needs"} & set(new)
    posts = corpus.count()
    products = [name for name in set(os.listdir(folder)) - before if name.startswith("tidemark-product-")]
    rows = spark.read.parquet(*[f"{folder}/{name}" for name in products]).where("chunk >= 0").agg(F.max(F.length("rows"))).first()[0]
    assert products and rows <= posts * 8 * 8


def test_terms_are_dealt_as_packed_keys_and_rare_words_get_their_numbers_in_a_join(spark, corpus):
    """Before, every term was sent as a string with its post, several times."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    sizes = {"head_terms": 256, "piece": 128}
    model = topics.fit_topics(corpus, n_topics=3, max_iter=4, tolerance=0, **sizes)
    made = [d for d in folder.iterdir() if d not in before and "-words-" not in d.name and "-word-codes-" not in d.name]
    assert not [d.name for d in made if "string" in str(spark.read.parquet(str(d)).drop("post_id").schema).lower()]
    few = topics.fit_topics(corpus, n_topics=3, max_iter=4, tolerance=0, head_words=100, **sizes)
    assert model.posts.words.tail is None and few.posts.words.tail.count() > 500 and few.posts.words.head.num_rows <= 100
    assert few.losses == pytest.approx(model.losses, rel=1e-9)
    expected = {r.post_id: r.topic for r in model.assign().collect()}
    assert {r.post_id: r.topic for r in few.assign(corpus).collect()} == expected


TAIL = {"head_terms": 256, "piece": 128}


def test_new_posts_are_written_and_dealt_once(spark, corpus):
    """Before, all columns of new posts were written with their words and again with their codes, and entries were dealt twice."""
    model = topics.fit_topics(corpus, n_topics=3, max_iter=3, tolerance=0, **TAIL)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    again = model.assign(corpus, keep=["post_id"])
    made = {d.name.split("-")[1]: spark.read.parquet(str(d)).columns for d in folder.iterdir() if d not in before}
    assert made == {"codes": ["post_id", "_row", "_chunk", "codes"], "product": ["chunk", "rows"]}
    expected = {r.post_id: r.topic for r in model.assign().collect()}
    assert again.columns == ["post_id", "topic"] and {r.post_id: r.topic for r in again.collect()} == expected
    whole = model.assign(corpus)
    assert whole.columns == ["post_id", "text", "topic"] and {r.post_id: r.topic for r in whole.collect()} == expected
    meeting = model.posts.meeting(model.loadings, model.posts.coded)
    assert meeting._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_entries_travel_packed_and_come_back(spark, corpus):
    from tidemark.operators import term_keys

    rng = np.random.default_rng(3)
    for some in (1, 7, 20_000):
        key = (rng.zipf(1.3, some).clip(max=1 << 20).astype(np.int64) << 31) + rng.integers(0, 3, some)
        key, post = np.unique(np.stack([key, rng.integers(3_000_000, 3_002_000, some)]), axis=1)
        n = np.minimum(rng.zipf(3, len(key)), 99).astype(np.int32)
        data = term_keys.packed(key, post.astype(np.int32), n)
        for got, want in zip(term_keys.unpacked_entries(data), (key, post, n)):
            assert np.array_equal(got, want)
    assert len(data) < 0.3 * 16 * len(key)
    parts = [term_keys.packed(k, p, n) for k, p, n in ((np.array([3, 3, 9]), np.array([4, 8, 1], np.int32), np.array([1, 2, 1], np.int32)),
                                                        (np.array([1, 9]), np.array([6, 0], np.int32), np.array([5, 7], np.int32)))]
    key, post, n = term_keys.entries_of(parts, 5)
    assert (key.tolist(), post.tolist(), n.tolist()) == ([3, 3, 9, 1, 9], [4, 8, 1, 6, 0], [1, 2, 1, 5, 7])
    # posts of a key need not ascend
    back = term_keys.unpacked_entries(term_keys.packed(np.array([5, 5, 5, 6]), np.array([7, 2, 9, 3], np.int32), np.ones(4, np.int32)))
    assert back[1].tolist() == [7, 2, 9, 3]


def test_frequent_words_are_looked_up_in_an_array(spark):
    """Before, tasks had a dictionary of a million words at most, and posts with others were all moved by a join."""
    from tidemark.operators import term_keys

    names = sorted(["ab", "abc", "abd", "a" * 16, "a" * 17, "a" * 18, "zz", "\u00e9"], key=str.encode)
    known = term_keys.known_words(pa.table([pa.array(names[::-1]), pa.array(range(len(names) - 1, -1, -1))], names=["term", "code"]))
    assert len(known[0]) == 6 and sorted(known[2]) == ["a" * 17, "a" * 18]
    assert term_keys.codes_of(pa.array(names), known).tolist() == list(range(len(names)))
    assert term_keys.codes_of(pa.array(["", "a", "aba", "a" * 19, "zzz", "zz"]).slice(1), known).tolist() == [-1, -1, -1, -1, names.index("zz")]
    none = term_keys.known_words(pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], names=["term", "code"]))
    assert term_keys.codes_of(pa.array(["ab", "a" * 20]), none).tolist() == [-1, -1] and not len(term_keys.codes_of(pa.array([], pa.string()), known))
    assert term_keys.HEAD_WORDS * (term_keys.WIDTH + 4) < 200e6


def test_too_many_long_words_meet_their_codes_in_a_join(spark, monkeypatch):
    from tidemark.operators import term_keys

    monkeypatch.setattr(term_keys, "LONG_WORDS", 2)
    long = [c * 20 for c in "abcdef"]
    counts = spark.createDataFrame([(w, 9 - i) for i, w in enumerate(long)] + [("short", 2), ("brief", 5)], "term string, documents long")
    words = term_keys.Words.of(counts)
    assert sorted(words.head.column("term").to_pylist()) == [*long[:1], long[1], "brief", "short"]
    assert sorted(r.term for r in words.tail.collect()) == long[2:]
    texts = [f"{a} brief {b} short" for a in long for b in long] * 2
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "post_id string, text string")
    got = {(r.post_id, r.term): r.weight for r in topics.tfidf(df).collect()}
    want = {(str(i), t): v for i, row in enumerate(plain_tfidf(texts)) for t, v in row.items()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_shuffles_of_a_fit_go_with_their_jobs(spark, corpus):
    """Before, they stayed until the driver's memory was collected, and the passes of a fit filled the disks."""
    import time

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = env.blockManager().diskBlockManager().localDirsString()
    found = lambda: {f.name for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = found(), spark.conf.get(name)
    model = topics.fit_topics(corpus, n_topics=3, max_iter=3, tolerance=0, **TAIL)
    model.assign(corpus)
    for _ in range(50):
        if not found() - before:
            break
        time.sleep(0.2)
    assert not found() - before and spark.conf.get(name) == setting
