"""Nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast, stored

TABLES = 4
PROJECTIONS = 6  # numbers that make a bucket
SAMPLE = 2000  # vectors the index is fitted on at most
SUCCESS = 0.97  # estimated chance that a query's buckets hold its k-th neighbour, over all tables
CELL = 4096  # vectors that a task holds at a time, about
ASKED = 4096  # points that ask, in a block of a cell
ROUNDS = 3  # searches by buckets, each of twice the reach, before what is left is compared with every vector


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Random projections, offsets and widths of every table, and the distance that probing allows for."""

    directions: np.ndarray  # (table, projection, dimension)
    offsets: np.ndarray  # (table, projection)
    width: float
    reach: float
    target: float  # chance per table

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, table, projection): where vectors fall, in slot widths."""
        return np.einsum("nd,tpd->ntp", vectors, self.directions) / self.width + self.offsets

    def probes(self, place: np.ndarray) -> list[tuple[int, ...]]:
        """Buckets of one table around ``place``, most likely first, until they hold a neighbour with the target chance.

        A neighbour at distance r falls normally around the query, with
        deviation r on each projection, so each slot has its chance and a
        bucket the product of its slots'. The slots of a projection are
        ordered by chance, and a heap of perturbations walks the buckets in
        order of their product.
        """
        spread = self.reach / self.width
        slots, logs = [], []
        for x in place:
            own = math.floor(x)
            around = np.arange(own - math.ceil(4 * spread) - 1, own + math.ceil(4 * spread) + 2)
            edges = np.array([0.5 * math.erfc((x - e) / spread / math.sqrt(2)) for e in [*around, around[-1] + 1]])
            chance = np.maximum(np.diff(edges), 1e-12)
            order = np.argsort(-chance, kind="stable")
            slots.append(around[order])
            logs.append(np.log(chance[order]))
        first = (0,) * len(place)
        heap = [(-sum(float(own[0]) for own in logs), first)]
        out, held = [], 0.0
        while heap and held < self.target:
            cost, ranks = heapq.heappop(heap)
            held += math.exp(-cost)
            out.append(tuple(int(slots[p][r]) for p, r in enumerate(ranks)))
            # Each vector of ranks has one parent: the one with its last non-zero rank one lower.
            last = max((p for p, r in enumerate(ranks) if r), default=0)
            for p in range(last, len(ranks)):
                if ranks[p] + 1 < len(logs[p]):
                    up = (*ranks[:p], ranks[p] + 1, *ranks[p + 1 :])
                    heapq.heappush(heap, (cost + float(logs[p][ranks[p]] - logs[p][ranks[p] + 1]), up))
        return out


def bucket_ids(buckets: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of slot numbers (table first)."""
    out = np.full(len(buckets), 0x9E3779B97F4A7C15, np.uint64)
    for column in buckets.T:
        out = (out ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def fit(vectors: DataFrame, k: int, tables: int = TABLES, projections: int = PROJECTIONS, sample: int = SAMPLE, success: float = SUCCESS) -> Index | None:
    """An index fitted on at most ``sample`` vectors of ``vectors`` (id, vector), chosen by a hash of the id.

    The reach is the distance of k-th neighbours among the sample, which
    neighbours among all vectors are not beyond; a slot is as wide as their
    spread on a projection. None without vectors.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if rows.empty:
        return None
    data = np.stack(rows["vector"].to_list()).astype(float)
    some = data[: max(1, len(data) // 10)]
    squares = (some**2).sum(1)[:, None] + (data**2).sum(1)[None] - 2 * some @ data.T
    near = np.sort(np.sqrt(np.maximum(squares, 0)), axis=1)[:, min(k, len(data) - 1)]
    reach = float(np.quantile(near, 0.9)) or 1e-6
    rng = np.random.default_rng(11)
    return Index(
        rng.normal(size=(tables, projections, data.shape[1])),
        rng.uniform(size=(tables, projections)),
        width=1.2 * reach,
        reach=reach,
        target=1 - (1 - success) ** (1 / tables),
    )


def search(vectors: DataFrame, queries: Column, k: int, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among the other rows.

    ``vectors`` has (vec_id, embedding) and maybe more columns; ``queries``
    says which rows ask. Score is the Euclidean distance in double precision;
    ties fall to the smaller vec_id. Rows with unusable vectors or null ids
    take no part; a query with fewer candidates returns them all; repeated
    rows are one; an empty table gives no rows.

    Equal vectors are one point that carries its k + 1 smallest ids, which is
    all a result can need of it, so copies crowd no bucket. Every point is
    filed once per table with its vector. Each query point lists its buckets;
    joined with the buckets' sizes, those that are empty drop out, and large
    ones are cut into chunks of about CELL points. Buckets are dealt to cells
    by hash; in a cell exact distances are taken, and each query's nearest of
    the cell leave it. These are merged per query. Points that found too few,
    or whose last lies beyond the reach that probing allows for, are searched
    again with twice the reach and width, and at last among all vectors.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct()
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    points = ranked.groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(points, "points")
    asking = rows.where("asks").select("vec_id", "vector").join(points.select("vector", "id"), "vector").select(F.col("vec_id").alias("query_id"), F.col("id").alias("point"))
    asking = stored(asking, "asking")
    index = fit(points, k, **options)
    if index is None:
        return asking.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asking.select("point").distinct().join(points.select(F.col("id").alias("point"), "vector"), "point")
    near, pending = None, stored(asked, "asked")
    needed = min(k + 1, ranked.count())
    for at in range(ROUNDS + 1):
        own = _by_buckets(points, pending, index, k) if at < ROUNDS else _by_all(points, pending, k)
        own = stored(own, "near")
        near = own if near is None else near.unionByName(own)
        if at == ROUNDS:
            break
        # A point carries at most k + 1 ids, so a list of needed ids is full.
        first = Window.partitionBy("point").orderBy("score", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        had = own.distinct().join(points.select("id", F.size("ids").alias("n")), "id").withColumn("n", F.sum("n").over(first))
        full = had.where((F.col("n") >= needed) & (F.col("score") <= index.reach)).select("point").distinct()
        pending = stored(pending.join(full, "point", "left_anti"), "pending")
        if pending.isEmpty():
            break
        index = replace(index, width=2 * index.width, reach=2 * index.reach)
    merged = near.distinct().withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    members = merged.join(points.select("id", "ids"), "id").select("point", F.explode("ids").alias("vec_id"), "score")
    # The point's k + 1 nearest ids are enough for each of its queries, which leaves itself out.
    listed = members.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    found = asking.join(listed, "point").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_buckets(points: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(point, id, score): the nearest of each point of ``asked`` in every cell that holds a bucket it probes."""
    shared = broadcast(points.sparkSession, index)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            ids, data = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector"))
            slots = np.floor(own.places(data)).astype(np.int64)
            for table in range(slots.shape[1]):
                keys = bucket_ids(np.column_stack([np.full(len(ids), table), slots[:, table]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), batch.column("vector")], names=["bucket", "id", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        for batch in batches:
            ids = batch.column("point").to_numpy(zero_copy_only=False)
            places = index.places(_matrix(batch.column("vector")))
            for i, own in enumerate(places):
                found = np.array([(t, *slots) for t, place in enumerate(own) for slots in index.probes(place)], np.int64)
                keys = bucket_ids(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), ids[i]))], names=["bucket", "point"])

    filed = stored(points.select("id", "vector").mapInArrow(file, "bucket long, id long, vector array<double>"), "filed")
    buckets = filed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int"))
    cells = max(1, -(-filed.count() // CELL))

    def chunk(of: Column) -> Column:
        return F.xxhash64("bucket", of)

    cell = F.pmod("chunk", F.lit(cells)).cast("int").alias("cell")
    large = buckets.where("chunks > 1").select("bucket", "chunks")
    held = filed.join(large, "bucket", "left").withColumn("chunk", chunk(F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int")))
    held = held.select(cell, "chunk", "id", "vector")
    # Listing buckets is work of its own, so it gets as many tasks as a shuffle has, however few the points.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A point lists some thousand buckets, and Spark takes the list to be as large as the point: merged, or it would be broadcast.
    probes = asked.repartition(tasks, "point").mapInArrow(probe, "bucket long, point long").join(buckets.select("bucket", "chunks").hint("merge"), "bucket")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("chunk", chunk(F.col("part")))
    probes = stored(probes.select(cell, "chunk", "point").groupBy("cell", "point").agg(F.collect_list("chunk").alias("wanted")), "probes")
    # A cell that many points ask meets them in blocks; one that none asks is left out.
    sizes = stored(probes.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks")), "sizes")
    wanted = probes.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("point"), "blocks").cast("int")).join(asked, "point")
    held = held.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "block"]
    return held.drop("blocks").groupBy(*keys).cogroup(wanted.drop("blocks").groupBy(*keys)).applyInPandas(_nearest(k), "point long, id long, score double")


def _by_all(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(point, id, score): the nearest of each point of ``asked`` in every block of vectors; blocks of both sides meet in a grid."""
    blocks, others = (max(1, -(-side.count() // CELL)) for side in (points, asked))

    def dealt(side: DataFrame, key: str, own: int, across: int, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(names[0])
        return side.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias(names[1]))

    held = dealt(points.select("id", "vector"), "id", blocks, others, ("block", "other")).withColumn("chunk", F.lit(0).cast("long"))
    wanted = dealt(asked, "point", others, blocks, ("other", "block")).withColumn("wanted", F.array(F.lit(0).cast("long")))
    keys = ["block", "other"]
    return held.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(_nearest(k), "point long, id long, score double")


def _nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Exact distances in a cell: each asking point's k + 1 nearest in the chunks it wants."""

    def of(points_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if points_.empty or asked_.empty:
            return pd.DataFrame({"point": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        points_ = points_.sort_values(["chunk", "id"])
        keys, ids, data = points_["chunk"].to_numpy(), points_["id"].to_numpy(), np.stack(points_["vector"].to_list())
        out = []
        for point, wanted, vector in zip(asked_["point"], asked_["wanted"], asked_["vector"], strict=True):
            wanted = np.asarray(wanted)
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            at = at[np.unique(ids[at], return_index=True)[1]]
            distance = np.sqrt(((data[at] - np.asarray(vector)) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], distance))[: k + 1]
            out.append(pd.DataFrame({"point": point, "id": ids[at][best], "score": distance[best]}))
        return pd.concat(out)

    return of


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)
