"""Salted author hashes."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

HASH_LENGTH = 16


def hash_author(author: Column, salt: str) -> Column:
    """First 16 hex digits of HMAC-SHA256(salt, normalized author); empty for no author.

    The salt travels inside the pickled function, not as a literal: plans, the UI and event logs never
    show it. Each distinct author of a batch is hashed once.
    """
    key = salt.encode("utf-8")

    def digest(name: str) -> str:
        name = name.strip().lower()
        return hmac.new(key, name.encode("utf-8"), hashlib.sha256).hexdigest()[:HASH_LENGTH] if name else ""

    @F.pandas_udf("string")
    def hashed(authors: pd.Series) -> pd.Series:
        codes, names = pd.factorize(authors)  # a missing author has code -1
        digests = [digest(name) for name in names] + [""]
        return pd.Series([digests[code] for code in codes], index=authors.index, dtype=object)

    return hashed(author.cast("string"))


def hash_author_native(author: Column, salt: str) -> Column:
    """The same value with built-in functions only. The salt shows in plans: for public salts only."""
    key = salt.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(byte ^ pad for byte in key)) for pad in (0x36, 0x5C))
    name = F.lower(strip(author.cast("string")))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(name, "UTF-8")), 256))
    return F.when(name != "", F.substring(F.sha2(F.concat(outer, first), 256), 1, HASH_LENGTH)).otherwise("")
