"""Columns of the caller under neutral names, so that no name of theirs can meet one of an operator."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Columns:
    """``frame`` holds the columns of ``df`` as _c0, _c1, ...; Spark compares names without case, and so does this."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.frame = df.toDF(*(f"_c{i}" for i in range(len(self.names))))

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_c{[n.lower() for n in self.names].index(name.lower())}")

    def neutral(self) -> list[str]:
        return [f"_c{i}" for i in range(len(self.names))]

    def back(self, replaced: Collection[str] = ()) -> list[Column]:
        """All columns by their own names, but for those in ``replaced``."""
        gone = {n.lower() for n in replaced}
        return [F.col(f"_c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in gone]
