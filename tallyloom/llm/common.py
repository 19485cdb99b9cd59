"""What several operators share: reading, scratch tables, worker memory, running totals, links."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import scratch_path, tune

# Separators of words in the contracts: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of one Arrow batch. Texts are long, so a batch is kept to some MB.
BATCH_ROWS = 256

# Bytes of a long text that are split into words at a time.
PIECE = 1 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """The session with the library's settings and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Used where a result is read more than once, or where an id made from the
    position of a row has to stay what it is.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_memo(name: str, make: Callable[[], Any]) -> Any:
    """An object kept as long as the Python worker lives, over its tasks.

    Functions are shipped by value, so their module's globals end with the task.
    """
    kept = sys.__dict__.setdefault("_tallyloom_memo", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def broadcast(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Send ``value`` to the workers; the function returned gives it there, to be called once a task.

    Like functions, objects go by value, so workers need not have the package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``PIECE`` bytes, cut at spaces; words stay whole."""
    start = 0
    while len(data) - start > PIECE:
        cut = data.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def source_key(source: Column) -> Column:
    """A key without nulls in code-point order of the sources, null last."""
    return F.when(source.isNull(), F.lit("T")).otherwise(F.concat(F.lit("S"), source.cast("string")))


def row_key(df: DataFrame) -> Column:
    """A text that tells rows apart by all their columns; equal rows share it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(*values).cast("string"))


def id_block(doc_id: Column) -> Column:
    """256 even blocks of documents, the same on every run."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 2)


def running_total(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the group, by (block, order).

    One task sees one block of one group, never a whole group; the blocks'
    own totals are the second level. ``group`` and ``block`` hold no nulls.
    """
    keys = [*group, block]
    before = Window.unboundedPreceding, -1
    inner = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before))
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    outer = F.sum("__total").over(Window.partitionBy(*group).orderBy(block).rowsBetween(*before))
    offsets = totals.select(*keys, F.coalesce(outer, F.lit(0)).alias("__before"))
    return (
        df.withColumn(name, F.coalesce(inner, F.lit(0)))
        .join(offsets, keys)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__before")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Alternating large and small stars: every round each node hands its
    neighbours to the smallest of them, until the links are stars. Rounds grow
    with the logarithm of the longest chain. A node's neighbours are never
    gathered; only their minimum is, and it is joined back. One task streams
    all links of a node past it.

    Every job of a round costs the driver memory for its plan and tasks. So
    nothing is broadcast, which is a job and a copy on the driver, the links
    are written where few tasks read them again, and rounds end as soon as
    the links are stars, not when a further round has changed nothing.
    """

    def star(links: DataFrame, larger: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = both if larger else links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = pairs.join(least.hint("merge"), "a")
        if larger:
            out = near.where("b > a").select(F.col("m").alias("a"), "b")
        else:
            # Each node meets its minimum in one row, which gives the node's own link.
            out = near.select(F.col("m").alias("a"), F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b"))
        return out.distinct()

    def stars(links: DataFrame) -> bool:
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))
        nodes = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.leaf").alias("leaf"), F.count("*").alias("n"))
        return nodes.where("leaf > 0 and n > 1").agg(F.count("*")).first()[0] == 0

    links = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not stars(links):
        links = stored(star(star(links, True), False), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
