"""Quality rules and source mix against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_of_documents(spark, small, small_docs):
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, small).collect()}
    assert len(got) == len(small_docs)
    for doc_id, text in small_docs:
        assert tuple(got[doc_id][n] for n in NAMES) == brute(text)
        assert not (got[doc_id].base_failed and got[doc_id].kept)


def test_odd_texts(odd):
    got = quality.apply_rules(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r[n] for n in NAMES) == brute(r.text)
        assert r.key == "k" and r.size == 1


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "word " * 60 + "* " * 40)], "doc_id long, text string")
    row = quality.apply_rules(docs, base=(), rules=(quality.Rule("many", "symbols_per_word", None, 0.1), quality.Rule("few", "n_words", 1000, None))).first()
    assert row.broken == ["many", "few"] and not row.kept and not row.base_failed


def test_plan_is_one_projection(odd):
    plan = quality.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_tables(none):
    assert quality.apply_rules(none).count() == 0
    assert mixing.mix(none).count() == 0


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, budget, out = set(order), min(share, most) * sum(sizes.values()), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if budget * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: budget * weight[s] / total for s in left}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        left -= over
    return out


def test_mix_of_documents(spark, small):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op8_source_mix"](spark, small).collect()
    again = queries.QUERIES["op8_source_mix"](spark, small).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    size, taken, largest = {}, {}, {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r["size"]
        s = rows[r.doc_id].source
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    wanted = shares(size)
    for r in got:
        s = rows[r.doc_id].source
        assert r.source_size == size[s] and r.target == pytest.approx(wanted[s])
    for s in size:
        assert abs(taken[s] - wanted[s]) <= largest[s]


def test_threshold_is_the_nearest_document(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 6}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", mixing.position_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    got = mixing.mixed_sizes(docs).collect()
    sizes, by = {}, {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t) // 2
        by.setdefault(s, []).append((hashes[d], len(t) // 2))
    wanted, taken = shares(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        taken[rows[r.doc_id][2]] += r.taken
    for s, size in sizes.items():
        total = wanted[s] // size * size
        for _, n in sorted(by[s]):
            if abs(total + n - wanted[s]) <= abs(total - wanted[s]):
                total += n
            else:
                break
        assert taken[s] == total


def test_mix_of_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert r["size"] == len(WORD.findall(r.text or "")) and r.key == "k"
    for r in got:
        assert r.target == pytest.approx(shares(sizes)[r.source]) and r.source_size == sizes[r.source]
    copies = mixing.repeated(mixing.mix(odd))
    assert copies.count() == sum(r.copies for r in got)


def test_one_source_holds_all(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mixed_sizes(docs).collect()
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) <= 7


CLASHING = ("whole", "below", "hash", "__hash", "__text", "__mine", "N_WORDS", "a.b", "a`b", "Size", "copy", "source_", "_c0", "kind", "row")


@pytest.fixture
def clashing(spark):
    """Extra columns with names that the operators use themselves, with other case, or hard to quote."""
    frame = spark.createDataFrame([(i, f"one two three word{i} " * 20, f"s{i % 2}", *range(len(CLASHING))) for i in range(6)])
    return frame.toDF("doc_id", "text", "source", *CLASHING)


def test_clashing_columns_of_the_mix(clashing):
    got = mixing.mix(clashing)
    assert got.columns == ["doc_id", "text", "source", *(c for c in CLASHING if c != "Size"), "size", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert len(rows) == 6 and all(r["a.b"] == CLASHING.index("a.b") and r["__mine"] == CLASHING.index("__mine") and r.size == 80 for r in rows)
    copies = mixing.repeated(got)
    assert copies.columns == ["doc_id", "text", "source", *(c for c in CLASHING if c != "Size")] and copies.count() == sum(r.copies for r in rows)


def test_clashing_columns_of_the_rules(clashing):
    got = quality.apply_rules(clashing)
    others = [c for c in CLASHING if c != "N_WORDS"]
    assert got.columns[:3 + len(others)] == ["doc_id", "text", "source", *others] and got.columns[-1] == "kept"
    assert all(r["__mine"] == CLASHING.index("__mine") and r["__text"] == CLASHING.index("__text") and r.n_words == 80 for r in got.collect())


def test_clashing_columns_of_the_masking(clashing):
    from tidemark.llm import private_data

    got = private_data.masked(clashing.withColumn("text", F.concat("text", F.lit("a@b.org"))))
    assert got.columns == clashing.columns
    assert all(r.text.endswith("<EMAIL>") and r["a.b"] == CLASHING.index("a.b") and r["row"] == CLASHING.index("row") for r in got.collect())
