"""Checked sizes for data that goes to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import as_table

BROADCAST_ROWS = 200_000


def settle(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Computes an aggregate once, into the shared folder, with a broadcast hint if it has no more than ``max_rows`` rows."""
    table = as_table(df, label)
    return F.broadcast(table) if table.count() <= max_rows else table


SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small input in fewer files than there are cores, dealt out to all cores by a unique key; others as they are.

    Text work on one file with a single row group would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores:
        return df
    largest = df.agg(F.max("_metadata.file_size")).first()[0]
    return df.repartition(cores, key) if largest and largest * files <= SPREAD_BYTES else df
