"""Pages of an ordered table, found by a directory of counted ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_pages(df: DataFrame, order: Sequence[Column], root: str) -> None:
    """Store the rows below ``root`` in ranges of ``order``, and how many each range holds.

    ``order`` has to be total. One range exchange; what is ordered after that
    is one row per range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    marked = ranged.withColumn("__part", F.shiftright("__at", 33))
    marked.write.partitionBy("__part").parquet(f"{root}/rows")
    rows = df.sparkSession.read.schema(marked.schema).parquet(f"{root}/rows")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("rows"), F.min("__at").alias("first_at"))
    before = F.sum("rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("first_row", F.coalesce(before, F.lit(0))).write.parquet(f"{root}/directory")


def seek_page(spark: SparkSession, root: str, schema: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of stored ranges; ``schema`` names the columns.

    The directory tells which ranges hold the page, the rows' places within
    them which rows to read: a late page costs what the first one does.
    """
    start = (number - 1) * size
    held = spark.read.parquet(f"{root}/directory").where((F.col("first_row") < start + size) & (F.col("first_row") + F.col("rows") > start))
    out = None
    for part in held.collect():  # the ranges of one page
        rows = spark.read.schema(f"{schema}, __at long").parquet(f"{root}/rows/__part={part['__part']}")
        low = part["first_at"] + max(0, start - part["first_row"])
        high = part["first_at"] + start + size - part["first_row"]
        some = rows.where((F.col("__at") >= low) & (F.col("__at") < high))
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.orderBy("__at").drop("__at")
