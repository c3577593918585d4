import hashlib
import zlib

import duckdb
import pytest

from tidemark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, level string, digest long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold(digests):
    """The last digest, and for each of the given ones the (left, right) siblings up to it."""
    paths, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(s, min(s + 8, len(digests))) for s in range(0, len(digests), 8)]
        for run in runs:
            for at in run:
                for i in below[at]:
                    paths[i].append(("".join(digests[j] for j in run if j < at), "".join(digests[j] for j in run if j > at)))
        below = [[i for at in run for i in below[at]] for run in runs]
        digests = [h("".join(digests[at] for at in run)) for run in runs]
    return digests[0], paths


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    groups = [sorted(by_lang[lang], key=lambda x: x[:3]) for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))]
    if not groups:
        return []
    folds = [fold([x[2] for x in g]) for g in groups]
    root, tops = fold([f[0] for f in folds])
    out = []
    for group, (subroot, paths), top in zip(groups, folds, tops, strict=True):
        for (_, _, own, row), path in zip(group, paths, strict=True):
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                node = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for a, b in path + top:
                node = h(a + node + b)
            out.append((row[0], own, subroot, root, h("".join(a + b for a, b in path + top)), node, node == root))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def report(spark, rows):
    return merkle.tampering_report(spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA))


@pytest.mark.parametrize("rows", [
    [],
    [(7, None, None, None, None)],
    [(1, "a", "en", 3, "ABc"), (2, "a", "en", 3, "ABc"), (2, "a", "en", 3, "ABc"), (None, "", "", 0, "É"), (None, None, None, None, "Q" * 300_000)],
    [(i, "s", "one", i, f"Text É {i}") for i in range(513)],
    [(i, f"s{i % 3}", f"l{i % 70}" if i % 5 else None, i, f"Text {i}") for i in range(400)],
    [(5, "s", "a", 1, "Same") for _ in range(70)] + [(6, "s", f"z{i}", 1, "Same") for i in range(9)],
], ids=["empty", "one", "odd", "one group", "groups", "equal rows"])
def test_proofs_against_brute_force(spark, rows):
    assert in_order(report(spark, rows).collect()) == in_order(brute(rows))


def test_ancestors_are_joined_by_shuffle_beyond_the_bound(spark, monkeypatch):
    rows = [(i, "s", f"l{i % 11}", i, f"Text {i}") for i in range(900)]
    expected = in_order(brute(rows))
    monkeypatch.setattr(merkle, "BROADCAST_ANCESTORS", 0)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 0)
    assert in_order(report(spark, rows).collect()) == expected


def test_sql_agrees_with_brute_force(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    rows = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    found = brute(rows)
    assert in_order(con.execute(queries.ORACLES["op13_merkle_manifest"]).fetchall()) == in_order(found)
    assert in_order(queries.op13_merkle_manifest(spark, small).collect()) == in_order(found)
    assert 0 < sum(not r[-1] for r in found) < len(found) / 2


def test_a_proof_can_be_checked_alone(spark):
    rows = [(i, "s", f"l{i % 3}", i, f"Text {i}") for i in range(100)]
    frame = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    for r in merkle.proofs(merkle.build(frame)).collect():
        node = leaf(rows[r.id])
        assert node == r.leaf
        for s in r.segments:
            node = h(s.left + node + s.right)
        assert node == r.root == r.folded_root


def test_chains_double(spark):
    rows = [(i, "s", "a", i, "t") for i in range(8 ** 3 + 1)]
    manifest = merkle.build(spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA))
    assert manifest.steps == 3
    lengths = {r.level: r.n for r in merkle.chains(manifest).selectExpr("level", "size(segments) AS n").distinct().collect()}
    assert lengths == {1: 3, 2: 2, 3: 1, 4: 0}
