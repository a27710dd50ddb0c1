"""Keeping joins splittable when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def behind_own_exchange(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, one or few per key, made ready to be joined with a side that may have a hot key.

    The adaptive skew join splits a hot key only where both sides of the join come straight
    from a shuffle. Rows that are themselves the result of a join or aggregation by `key` are
    already partitioned by it and would be joined in place. Spread by another hash first, they
    are shuffled by `key` for the join; what moves is the small side.
    """
    return rows.repartition(F.xxhash64(key))
