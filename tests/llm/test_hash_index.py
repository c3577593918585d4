import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hash_index, queries


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        same = groups[lower(t)]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), hashlib.sha256(lower(t).encode()).hexdigest()))
    return Counter(out)


def checked(found, rows):
    found = found.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute(rows)
    stays = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in stays)
    assert sorted(r.text_sha256 for r in stays) == sorted({r.text_sha256 for r in found})
    return found


def test_odd_texts(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    checked(hash_index.duplicates(odd), rows)
    empty = hash_index.duplicates(none)
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize(("bits", "capacity"), [(64, 16_384), (64, 5), (3, 2), (1, 1)], ids=["production", "small buckets", "shared keys", "two keys"])
def test_against_brute_force(spark, bits, capacity):
    rows = [(i, f"Text {i % 150 if i % 3 else 7}") for i in range(600)] + [(5, "TEXT 7"), (599, "text 7"), (None, "text 7"), (None, "alone")]
    found = checked(hash_index.duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), capacity=capacity, key_bits=bits), rows)
    chains = {r.chain for r in found if r.chain is not None}
    assert chains == {0} if bits == 64 else len(chains) > 5


def test_large_groups_are_joined_alike(spark, monkeypatch):
    rows = [(i, "Same" if i % 3 else f"t{i // 2}") for i in range(300)]
    monkeypatch.setattr(hash_index, "MOST_LARGE_GROUPS", 2)
    checked(hash_index.duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = [(i, f"t{i % 400}") for i in range(700)]
    monkeypatch.setattr(hash_index, "MOST_BITMAP_BITS", 1 << 6)
    checked(hash_index.duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_directory_doubles_where_a_bucket_is_overfull():
    counts = np.zeros(1 << 4, np.int64)
    assert hash_index.grow(counts, 3).depth == 0
    counts[:] = 1
    even = hash_index.grow(counts, 4)
    assert even.depth == 2 and even.n_buckets == 4
    counts[:] = 0
    counts[5], counts[6] = 3, 2
    uneven = hash_index.grow(counts, 3)  # 0101 and 0110 part at their third bit
    assert uneven.depth == 3 and uneven.pointers.tolist() == [0, 0, 1, 2, 3, 3, 3, 3]
    counts[5] = 50  # one slot that no bit divides stays overfull
    assert hash_index.grow(counts, 3).depth == 4


def test_buckets_are_key_ranges_on_shared_files(spark, tmp_path):
    rows = [(i, f"t{i % 500}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.select(hash_index.key_of(F.col("text")).alias("key")).distinct()
    places = hash_index.directory(keys, 40)
    chains = hash_index.write_chains(docs, keys, places, str(tmp_path / "buckets"))
    ranges = sorted((r.bucket, r.low, r.high, r.n) for r in chains.withColumn("slot", F.shiftrightunsigned("key", 40)).groupBy("bucket").agg(
        F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("*").alias("n")).collect())
    assert places.n_buckets > 12 and sum(r[3] for r in ranges) == 500
    assert all(r[3] <= 40 for r in ranges) and all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
    assert len(list((tmp_path / "buckets").glob("bucket=*/*.parquet"))) == len(ranges)


def test_sql_agrees(spark, small, small_docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    expected = sorted(con.execute(queries.ORACLES["op12_hash_index"]).fetchall())
    assert sorted(map(tuple, queries.op12_hash_index(spark, small).collect())) == expected
    checked(hash_index.duplicates(spark.createDataFrame(small_docs, "doc_id long, text string")), small_docs)
