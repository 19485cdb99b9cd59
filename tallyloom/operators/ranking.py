"""Best, latest and top-k rows: a rank filter keeps at most k rows per key and task before
the shuffle, so a key holding a third of all rows costs its reader no more than any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``.

    Planned as a group limit of 1 on either side of the exchange: a task sends
    at most one row per key, whole rows are never buffered in an aggregate.
    """
    return top_per_key(df, keys, order, 1, "__first").drop("__first")


def best_detection(detections: DataFrame, key: str, confidence: str, position: str) -> DataFrame:
    """Highest confidence per key; the earlier row wins a tie."""
    return best_per_key(detections, [key], F.desc(confidence), F.asc(position))


def last_wins(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """A later document replaces an earlier one of the same key."""
    return best_per_key(df, keys, *[F.desc(c) for c in order])


def latest_per(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    return best_per_key(df, keys, F.desc(ts), F.desc(tie))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def rank_boxes(boxes: DataFrame, image: str = "path", score: str = "confidence", tie: str = "box") -> DataFrame:
    """Boxes of each image numbered from the most confident on; equal ones by ``tie``."""
    order = Window.partitionBy(image).orderBy(F.desc(score), F.asc(tie))
    return boxes.withColumn("place", F.row_number().over(order))


def rank_hits(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """1-based rank of hits by score per query; equal scores by id."""
    return top_per_key(hits, [query], [F.desc("score"), F.asc("id")], k)


def first_per_mall(offers: DataFrame, keys: Sequence[str], *order: Column, mall: str = "mall_name") -> DataFrame:
    """The cheapest offer of each mall."""
    return best_per_key(offers, [*keys, mall], *order)


def rank_offers(offers: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 5) -> DataFrame:
    return top_per_key(offers, keys, order, k)


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """The n newest rows: a top-n per task and one small merge, no global sort."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1); ``order`` has to be total for stable pages."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def random_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in a random order fixed by the seed, whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key))), F.col(key)).limit(n)
