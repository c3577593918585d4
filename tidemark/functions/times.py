"""Timestamps and periods. A time without a zone is UTC, whatever the session time zone is."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fixed

# layouts tried in order after the ISO forms
TIME_FORMATS = (
    "yyyy/M/d H:m:s",
    "yyyy/M/d",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "M/d/yyyy",
    "MMM d HH:mm:ss Z yyyy",
    "MMM d HH:mm:ss yyyy",
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy",
)
_DAY_NAME = r"^\s*(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"
_ISO = r"^\d{4}-\d{1,2}(?:-\d{1,2}(?:[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?$"
_HAS_ZONE = r"[T ]\d{1,2}:[\d:.]+\s*(?:Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)$"
_SHORT_OFFSET = r"([+-]\d{2})(\d{2})$"
_NO_SECONDS = r"([T ]\d{1,2}:\d{1,2})(?=\s*(?:$|[A-Z+-]))"


def parse_time(text: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Per-row mixed layouts to a UTC timestamp; null where no layout fits."""
    raw = F.regexp_replace(F.btrim(text), _DAY_NAME, "")
    iso = F.regexp_replace(F.when(raw.rlike(_ISO), raw), _NO_SECONDS, "$1:00")
    iso = F.when(iso.contains(":"), F.regexp_replace(iso, _SHORT_OFFSET, "$1:$2")).otherwise(iso)
    # an explicit zone is appended where none is given, so that the session zone never matters
    zoned = F.when(iso.rlike(_HAS_ZONE), iso).when(iso.contains(":"), F.concat(iso, F.lit("Z")))
    zoned = F.coalesce(zoned, F.concat(iso, F.when(F.length(iso) < 8, "-01").otherwise(""), F.lit("T00:00:00Z")))
    parsed = [zoned.try_cast("timestamp")]
    for layout in formats:
        if layout.endswith("Z") or " Z " in layout:
            parsed.append(F.try_to_timestamp(raw, F.lit(layout)))
        else:
            parsed.append(F.try_to_timestamp(F.concat(raw, F.lit(" +0000")), F.lit(layout + " Z")))
    return F.coalesce(*parsed)


def as_utc(df: DataFrame, column: str, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """The column as a UTC timestamp, by its type."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp":
        return F.col(column)
    if kind in ("timestamp_ntz", "date"):
        return F.to_timestamp(
            F.concat(F.date_format(F.col(column).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
        )
    return parse_time(F.col(column).cast("string"), formats)


def cutoff_literal(df: DataFrame, column: str, cutoff: date) -> Column:
    """UTC midnight of the cutoff day in the column's own timestamp type."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("timestamp_ntz", "date"):
        return F.expr(f"TIMESTAMP_NTZ '{cutoff.isoformat()} 00:00:00'")
    return F.expr(f"TIMESTAMP '{cutoff.isoformat()} 00:00:00Z'")


def assign_period(df: DataFrame, cutoff: date = fixed.CUTOFF, column: str = "created_at") -> DataFrame:
    """Adds ``period``: ``post`` on and after the cutoff day (UTC), else ``pre``."""
    edge = cutoff_literal(df, column, cutoff)
    return df.withColumn("period", F.when(F.col(column) >= edge, "post").otherwise("pre"))
