"""Shingle join, repeat removal and cap filters against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import cap_filters, components, queries, repeats, shingle_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingle_set(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain_join(texts, percent=85, width=4):
    sets = {d: shingle_set(t, width) for d, t in texts}
    groups, holders = Groups(), {}
    for d in sorted(sets):
        common = {}
        for g in sets[d]:
            for e in holders.setdefault(g, []):
                common[e] = common.get(e, 0) + 1
            holders[g].append(d)
        for e, k in common.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                groups.link(d, e)
    return {d: (len(sets[d]), groups.root(d)) for d in sets}


def copies(n=120):
    """A large group of near copies around one text, a passage that all share, and unrelated texts."""
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(random.choice(words, 90))
    passage = " ".join(random.choice(words, 25))
    rows = []
    for i in range(n):
        text = list(base)
        for at in random.integers(0, 90, i % 5):
            text[at] = f"new{i}"
        rows.append((i, " ".join(text)))
        rows.append((1000 + i, passage + " " + " ".join(random.choice(words, 5 + i % 40))))
    return rows + [(5000, rows[0][1].upper()), (5001, rows[0][1])]


def test_join_of_documents(spark, small, small_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op9_shingle_join"](spark, small).collect()}
    assert got == plain_join(small_docs)


def test_join_of_near_copies_in_small_pieces(spark, monkeypatch):
    rows = copies()
    monkeypatch.setattr(shingle_join, "PER_SEND", 500)
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    monkeypatch.setattr(shingle_join, "PER_MEETING", 300)
    monkeypatch.setattr(shingle_join, "FREQUENT", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs).collect()}
    assert got == plain_join(rows)


def test_join_after_few_hubs(spark, monkeypatch):
    rows = copies()
    for name, value in (("HUBS", 1), ("ROUNDS", 1), ("BLOCK", 32), ("BLOCK_SHINGLES", 2_000), ("PER_CHECK", 2_000), ("POSTINGS_PER_SEND", 300),
                        ("REMEMBERED", 5), ("PAIRS_PER_STEP", 200)):
        monkeypatch.setattr(shingle_join, name, value)
    monkeypatch.setattr(shingle_join.hub_links, "__defaults__", (1,))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs).collect()}
    assert got == plain_join(rows)


def test_sets_just_apart_make_no_rows_of_pairs(spark, monkeypatch):
    """31 texts, any two of which have a similarity of 0.83: the sketches of most pairs pass, no pair links."""
    base = " ".join(f"w{i}" for i in range(203))
    rows = [(k, base + "".join(f" own{k}x{i}" for i in range(20))) for k in range(31)]
    made, write = [], shingle_join.as_table

    def counted(df, label, *rest):
        table = write(df, label, *rest)
        if label.endswith(("-pairs", "-links")) and label != "join-hub-pairs":
            made.append(table.count())
        return table

    monkeypatch.setattr(shingle_join, "as_table", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_join(rows) == {k: (220, k) for k in range(31)}
    assert sum(made) <= shingle_join.ROUNDS * len(rows)


def test_pipeline_stage_joins_five_words_at_four_fifths(spark):
    words = [f"w{i}" for i in range(200)]
    block = words[:90] + [f"n{i}" for i in range(18)] + words[108:]
    edited = [f"e{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    texts = [*copies(40), (6000, " ".join(words)), (6001, " ".join(block)), (6002, " ".join(edited)),
             (6003, " ".join(f"x{i}" for i in range(200))),
             (6004, " ".join(f"y{i}" if 80 <= i < 97 else f"x{i}" for i in range(200)))]
    narrow, wide = plain_join(texts), plain_join(texts, 80, 5)
    assert narrow[6004][1] == 6004 and wide[6004][1] == 6003
    docs = spark.createDataFrame([(d, t, "xx", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(d for d, (_, root) in wide.items() if d == root)


def test_join_of_odd_texts(odd):
    got = shingle_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2
    assert by[3].n_shingles == by[4].n_shingles == 1 and by[4].component_id == 4
    assert by[5].component_id == by[6].component_id == by[10].component_id == 5
    assert {r.component_id for r in got if r.doc_id == 12} == {12}
    assert {r.component_id for r in got if r.doc_id is None} == {5, None}


def test_sketches_never_exceed_the_difference():
    random = np.random.default_rng(0)
    for _ in range(100):
        a = np.unique(random.integers(0, 2**63, random.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate((a[random.random(len(a)) < 0.9], random.integers(0, 2**63, 5).astype(np.uint64))))
        x, y = (np.frombuffer(shingle_join.sketch_of(s), np.uint8)[None] for s in (a, b))
        size = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(shingle_join.folded(x, size) ^ shingle_join.folded(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    random = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    groups = Groups()
    for a, b in links:
        if b is not None and a != b:
            groups.link(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: groups.root(x) for x in list(groups)}


def plain_repeats(texts, span=50):
    seen, out = set(), {}
    for d, text in sorted(texts):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        strings = [raw[i:i + span] for i in range(len(raw) - span + 1)]
        for i, s in enumerate(strings):
            if s in seen:
                gone[i:i + span] = True
        seen.update(strings)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def as_rows(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


@pytest.mark.parametrize("size", [12_000_000, 40_000])
def test_repeats_of_documents(spark, small, small_docs, monkeypatch, size):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
    assert as_rows(queries.QUERIES["op7_previous_factors"](spark, small)) == plain_repeats(small_docs)


def test_repeats_of_passages(spark, monkeypatch):
    random = np.random.default_rng(2)
    letters = np.array(list("abcdé "))
    passages = ["".join(random.choice(letters, n)) for n in (30, 49, 50, 51, 80, 200)]
    rows = [(i, "".join(random.choice(letters, int(random.integers(0, 60)))) + passages[int(random.integers(0, 6))]
             + "".join(random.choice(letters, int(random.integers(0, 30)))) + passages[int(random.integers(0, 6))]) for i in range(150)]
    rows += [(200, "z" * 400), (201, "z" * 120), (202, "ab" * 100), (203, "ab" * 60), (204, rows[0][1]), (205, "x" * 49), (206, "x" * 49)]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 5000)
    assert as_rows(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_repeats(rows)


def test_a_passage_of_all_documents_is_spread_over_the_buckets():
    random = np.random.default_rng(8)
    letters = np.array(list("abcdefgh "))
    passage = "".join(random.choice(letters, 200))
    texts = ["".join(random.choice(letters, 100)) + passage + "".join(random.choice(letters, 100)) for _ in range(640)]
    frame = pd.DataFrame({"doc_id": range(640), "text": texts, "chunk": np.arange(640) // 80})
    chunks, steps = [x for _, x in frame.groupby("chunk")], repeats.Steps(16)
    answers = lambda sent, settle: pd.concat([settle(x) for _, x in pd.concat(sent).groupby("bucket")])
    of = lambda told, c: told[told["chunk"] == c["chunk"].iloc[0]]
    shared = answers([steps.send_hashes(c) for c in chunks], steps.find_shared)
    sent = pd.concat([steps.send_contexts(c, of(shared, c)) for c in chunks])
    held = sent.groupby("bucket")["context"].agg(lambda x: sum(map(len, x)) // 8)
    assert held.sum() > 1280 and held.max() <= held.sum() / 6
    settled = pd.concat([steps.settle_contexts(x) for _, x in sent.groupby("bucket")])
    opened = pd.concat([steps.open_contexts(c, of(settled, c)) for c in chunks])
    sent = pd.concat([steps.send_heads(c, of(opened, c)) for c in chunks])
    held = sent.groupby("bucket")["hashes"].agg(lambda x: sum(len(repeats.unpacked_sorted(y)) for y in x))
    assert held.sum() > 1280 and held.max() <= held.sum() / 16


def test_only_open_runs_are_hashed():
    random = np.random.default_rng(3)
    docs = [(random.integers(0, 256, n).astype(np.uint8), np.array(runs, np.int64).reshape(-1, 2)) for n, runs in (
        (300, [(0, 20), (60, 61), (200, 251)]), (40, []), (50, [(0, 1)]), (120, [(10, 71)]))]
    got = repeats._heads_of_runs(docs)
    for (raw, runs), (start, head, check) in zip(docs, got, strict=True):
        assert start.tolist() == [i for a, b in runs for i in range(a, b)]
        if len(start):
            all_heads, all_checks = repeats.heads(raw)
            assert (head == all_heads[start]).all() and (check == all_checks[start]).all()
    at = np.array([5, 30, 33, 140, 280])
    covered = sorted({s for x in at for s in range(max(x - 30, 0), min(x, 250) + 1)})
    assert [i for a, b in repeats._starts(300, at) for i in range(a, b)] == covered


def test_repeats_of_odd_texts(odd):
    got = repeats.remove_repeats(odd, with_text=True).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert all(r.n_removed == 0 for r in got if r.doc_id in (None, 12, 8))


def test_nothing(none, spark):
    assert shingle_join.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cap_filters.near_duplicates(empty).count() == 0


def cluster_rows(dims=24):
    random = np.random.default_rng(4)
    centers = random.standard_normal((40, dims))
    rows = []
    for i in range(600):
        x = centers[i % 40] + random.standard_normal(dims) * (0.05 if i % 3 else 0.5)
        rows.append((i, [float(v) for v in x * (1 + i % 4)], i % 40 % 3))
    rows += [(700 + i, rows[1][1], rows[1][2]) for i in range(30)]
    rows += [(800, None, 1), (801, [0.0] * dims, 1), (802, [float("nan")] * dims, 1), (803, [None] * dims, 1), (804, rows[1][1], None),
             (805, [], 1), (806, [1.0, 2.0], 1), (807, [2.0, 4.0], 1), (None, rows[1][1], rows[1][2]), (809, [1e308] * dims, 2)]
    return rows


def test_cap_filters(spark):
    rows = cluster_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("data", F.lit("x"))
    got = cap_filters.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v)), label) for i, v, label in rows
            if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links, groups = {i: set() for i in good}, Groups()
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98:
                links[a].add(b)
                links[b].add(a)
                groups.link(a, b)
    total = sum(map(len, links.values()))
    by = {r.vec_id: r for r in got}
    assert 0.9 * total <= sum(by[i].n_links for i in good) <= total and total > 1000
    assert all(by[i].n_links <= len(links[i]) for i in good)
    assert sum(by[i].component_id != groups.root(i) for i in good) <= 0.02 * len(good)
    for i in {r[0] for r in rows} - set(good):
        assert by[i].n_links == 0 and by[i].component_id == i and by[i].kept


@pytest.mark.parametrize("hot_classes", [1, 30, 10**6])
def test_hot_vectors_are_told_the_same(spark, monkeypatch, hot_classes):
    frame = spark.createDataFrame(cluster_rows(), "vec_id long, embedding array<double>, label int")
    want = sorted(map(str, cap_filters.near_duplicates(frame).collect()))
    monkeypatch.setattr(cap_filters, "HOT_CLASSES", hot_classes)
    assert sorted(map(str, cap_filters.near_duplicates(frame).collect())) == want


def test_threshold_of_caps():
    dims, size, wanted = 16, 64, 20
    random = np.random.default_rng(3)
    x = random.standard_normal((300, dims))
    first, second = cap_filters._scores(x / np.linalg.norm(x, axis=1, keepdims=True), dims, size)
    lists = [cap_filters.decode(a, b, cap_filters.threshold(dims, size, wanted)) for a, b in zip(first, second)]
    assert 0.8 * wanted < np.mean([len(n) for n in lists]) < 1.2 * wanted


def test_block_meetings_find_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(cluster_rows(), "vec_id long, embedding array<double>, label int")
    want = sorted(map(str, cap_filters.near_duplicates(frame).collect()))
    monkeypatch.setattr(cap_filters, "BLOCK", 3)
    monkeypatch.setattr(cap_filters, "PER_BUCKET", 200)
    assert sorted(map(str, cap_filters.near_duplicates(frame).collect())) == want


def test_decode_lists_all_filters():
    random = np.random.default_rng(6)
    for _ in range(50):
        a, b = random.standard_normal(12), random.standard_normal(9)
        want = [i * 9 + j for i in range(12) for j in range(9) if a[i] + b[j] >= 1.0]
        assert cap_filters.decode(a, b, 1.0).tolist() == want
