import tempfile
from pathlib import Path

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-"))


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


#: texts that every operator must stand: null, empty, blank, ties, copies, one very long word and text
ODD_TEXTS = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two three"), (5, "One TWO three four five"), (6, "one two three four five"),
    (7, "a b c " * 40_000), (8, "x" * 200_000), (9, "é ß 漢字 😀 <|endoftext|> &amp; \x1c end"), (10, "one two three four five"), (None, "one two three four five"),
    (None, None), (12, "same words here " * 30), (12, "same words here " * 30), (13, "\n\n".join(["a line of five words"] * 20)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with extra columns whose names the operators use themselves."""
    rows = [(i, t, "xx", None if i in (1, 2) else f"s{(i or 0) % 3}", len(t or ""), 1, "k", None) for i, t in ODD_TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bucket int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -5")
