"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again before the next
one runs, so no stage carries the lineage of another and a lost executor costs at most a part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, private_data, quality, queries, shingle_join
from tidemark.storage import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: words of a shingle and least similarity of near duplicates
WIDTH, PERCENT = 5, 80
#: words that a worker of the packing stage gathers: its ids travel with the pieces and need the memory
REMEMBERED = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.apply_rules(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Texts without words stay.

    The rule of the stage is five words and 0.8; the defaults of the join are those of its own query.
    """
    found = shingle_join.near_duplicates(docs, width=WIDTH, percent=PERCENT)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return private_data.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, sequence and place; ``copy`` tells the rows of one document apart."""
    return packing.pack(packing.pieces(docs, queries.tokenizer_path(), with_ids=True, with_copy=True, remembered=REMEMBERED))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: the packing stage is not SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
