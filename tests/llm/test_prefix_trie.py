import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, path string, size int, shard long"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in found if len(paths[c]) == len(node)))
        out.append((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(frame), **settings).collect()), key=str)


def dialogues(n, seed, alphabet=3):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), draw.choice("abcdef"[:alphabet]) * draw.randint(0, 2))
            for c in range(n) for t in range(draw.randint(1, 9))]


@pytest.mark.parametrize("rows", [
    [],
    [(3, None, None, None)],
    [(None, 1, "user", "nobody's")],
    [(0, 2, "user", "é"), (0, None, "system", "first"), (0, 2, "user", "é"), (1, 1, "user", None), (4, 1, "user", "x" * 300_000), (12, 5, "user", "no parent")],
    [(c, t, "user", "same") for c in range(60) for t in range(4)],
    [(c, t, "user", f"{c} {t}") for c in range(2) for t in range(700)],
], ids=["empty", "one", "no id", "odd", "copies", "long"])
def test_odd_tables(spark, rows):
    assert nodes(spark, rows) == brute(rebuilt(rows))


@pytest.mark.parametrize("shards", [1, 40])
def test_against_brute_force(spark, monkeypatch, shards):
    rows = dialogues(500, seed=shards)
    assert nodes(spark, rows, shard_rows=max(1, 500 // shards)) == brute(rebuilt(rows))


def test_borders_change_nothing(spark, monkeypatch):
    rows = dialogues(300, seed=5, alphabet=2) + [(c, t, "user", "same") for c in range(1000, 1300) for t in range(12)]
    expected = brute(rebuilt(rows))
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 120)  # splitters of two turns
    assert nodes(spark, rows, shard_rows=10) == expected
    monkeypatch.setattr(prefix_trie, "PIECE", 32)  # id lists in pieces of four
    monkeypatch.setattr(prefix_trie, "SKELETON_NODES", 1 << 18)
    assert nodes(spark, rows, shard_rows=10) == expected


def test_nodes_of_two_shards_are_prefixes_of_splitters(spark):
    rows = dialogues(400, seed=9)
    frame = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)
    paths = prefix_trie.rebuilt(frame)
    splitters = prefix_trie._splitters(paths, 30)
    assert splitters == sorted(splitters) and len(splitters) == 29
    known, parents, depths = prefix_trie._skeleton(splitters)
    shards = defaultdict(set)
    for r in paths.collect():
        shard = sum(s <= (r.path, r.conv_id) for s in splitters)
        for d in range(0, len(r.path) + 1, prefix_trie.DIGEST):
            shards[r.path[:d]].add(shard)
    shared = {p for p, s in shards.items() if len(s) > 1}
    assert shared and all(any(s.startswith(p) for s, _ in splitters) for p in shared)
    assert len(parents) == len(known) + 1 == len({s[:d] for s, _ in splitters for d in range(0, len(s) + 1, prefix_trie.DIGEST)})
    assert max(depths) <= 9


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    expected = brute(rebuilt(rows))
    assert sorted(con.execute(queries.ORACLES["op11_prefix_trie"]).fetchall(), key=str) == expected
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, small).collect()), key=str) == expected
