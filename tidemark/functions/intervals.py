"""Intervals for shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed


def wilson(successes: Column, n: Column, z: float = fixed.Z_95) -> tuple[Column, Column]:
    """Wilson bounds of a share, within [0, 1]; null for n = 0."""
    size = F.when(n > 0, n.cast("double"))
    share = successes / size
    spread = 1 + z * z / size
    middle = (share + z * z / (2 * size)) / spread
    half = z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size)) / spread
    # greatest and least skip nulls, so the bounds need the guard again
    low = F.when(n > 0, F.greatest(F.lit(0.0), middle - half))
    high = F.when(n > 0, F.least(F.lit(1.0), middle + half))
    return low, high


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column, z: float = fixed.Z_95) -> tuple[Column, Column, Column]:
    """Difference of two shares (second minus first) with its bounds; null where a group is empty."""
    p1, p2 = x1 / F.when(n1 > 0, n1.cast("double")), x2 / F.when(n2 > 0, n2.cast("double"))
    low1, high1 = wilson(x1, n1, z)
    low2, high2 = wilson(x2, n2, z)
    diff = p2 - p1
    return (
        diff,
        diff - F.sqrt(F.pow(p2 - low2, 2) + F.pow(high1 - p1, 2)),
        diff + F.sqrt(F.pow(high2 - p2, 2) + F.pow(p1 - low1, 2)),
    )
