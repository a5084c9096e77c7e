"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_keys(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` distinct keys, those with the smallest hashes.

    Only hashes under a bound that about twice the limit passes are sorted, so
    what tasks send to the driver stays bounded whatever their number.
    """
    n = rows.count()
    share = min(1.0, 2 * limit / n) if n else 1.0
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    digest = F.xxhash64(key)
    return rows.select(key).filter(F.col(key).isNotNull() & (digest <= bound)).distinct().orderBy(digest, key).limit(limit)
