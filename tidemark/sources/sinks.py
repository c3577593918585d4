"""Sinks. Scores are written without their texts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: times in full, and a mark for nulls that is not an empty text
_CSV = {
    "escape": '"', "nullValue": "\\N", "emptyValue": "", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_prepared(posts: DataFrame, manifest: DataFrame, folder: str, file_format: str = "parquet") -> None:
    """``posts`` by period and a one-row ``manifest``."""
    writer = posts.write.mode("overwrite").partitionBy("period")
    if file_format == "csv":
        writer = writer.options(header=True, quoteAll=True, **_CSV)
        schema = posts.sparkSession.createDataFrame([(posts.schema.json(),)], "schema string")
        schema.write.mode("overwrite").json(f"{folder}/schema")
    writer.format(file_format).save(f"{folder}/posts")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def read_prepared(spark: SparkSession, folder: str, file_format: str = "parquet") -> DataFrame:
    """What ``write_prepared`` wrote, with the types it had."""
    if file_format != "csv":
        return spark.read.format(file_format).load(f"{folder}/posts")
    schema = StructType.fromJson(json.loads(spark.read.json(f"{folder}/schema").first()["schema"]))
    inside = StructType([field for field in schema if field.name != "period"])
    whole = StructType([*inside, *(field for field in schema if field.name == "period")])
    read = spark.read.schema(whole).options(header=True, multiLine=True, **_CSV).csv(f"{folder}/posts")
    return read.select(*schema.names)


def write_scores(scored: DataFrame, folder: str) -> None:
    scored.drop("text").write.mode("overwrite").partitionBy("period").parquet(f"{folder}/scores")


def write_report(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One JSON table per result. The results are a few rows each."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{folder}/report/{name}")
