"""Set algebra over keys and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def key_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side; each side is made distinct before the shuffle."""
    return left.select(key).union(right.select(key)).distinct()


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """One table out of feeds whose columns differ; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def unseen(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``new`` that ``seen`` does not hold."""
    return new.select(key).distinct().join(seen.select(key), key, "left_anti")
