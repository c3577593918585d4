"""Every registered query against its SQL equivalent, on the smallest tables."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalogue import queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(comparable(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, str(FOLDER))
    rows = df.collect()
    assert rows
    if name in entry.oracle_sql():
        cursor = sql.execute(entry.oracle_sql()[name])
        names = [column[0] for column in cursor.description]
        assert sorted(names) == sorted(df.columns)
        kinds = dict(zip(names, (str(column[1]) for column in cursor.description)))
        assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
        assert table(df.columns, rows) == table(names, cursor.fetchall())


def test_every_equivalent_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", ["light_clean", "english_and_spam", "filter_report", "filtered_posts", "lexicon_scores",
                                  "sentiment_shares", "pattern_match", "mean_differences_text", "moderation_share_diff",
                                  "balanced_sample"])
def test_plans_hold_no_cross_join_window_or_python(spark, name):
    plan = entry.queries()[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "NestedLoopJoin", "Window", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


def test_partitions_of_a_query_stay_small(spark):
    few, many = (queries.in_partitions(spark.range(n), 1) for n in (1_000, 3 * queries.PER_PARTITION - 1))
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sizes(few) == [1_000]
    assert len(sizes(many)) == 3 and max(sizes(many)) <= queries.PER_PARTITION + 8
