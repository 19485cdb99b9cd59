"""Tables: JDBC and file sinks, documents, landing partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    condition: Column | None = None,
    columns: Sequence[str] = (),
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """JDBC scan; the filter and the columns are pushed to the server.

    ``split`` = (column, low, high, partitions) reads in parallel; without it
    a JDBC scan is one task.
    """
    if split:
        column, low, high, parts = split
        df = spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=dict(properties))
    else:
        df = spark.read.jdbc(url, table, properties=dict(properties))
    return scan(df, condition, columns)


def scan(df: DataFrame, condition: Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Equality filter and projection of a table scan."""
    df = df if condition is None else df.filter(condition)
    return df.select(*columns) if columns else df


def append_table(df: DataFrame, path: str | None = None, *, url: str | None = None, table: str | None = None, properties: Mapping[str, str] | None = None) -> None:
    """Append to a parquet table, or to a JDBC table where a url is given."""
    if url:
        df.write.mode("append").jdbc(url, table, properties=dict(properties or {}))
    else:
        df.write.mode("append").parquet(path)


def append_docs(df: DataFrame, path: str, connector: str = "json", **options: str) -> None:
    """Append rows as documents through a connector; JSON lines by default."""
    df.write.format(connector).options(**options).mode("append").save(path)


def write_partition(df: DataFrame, root: str, fmt: str = "json") -> None:
    """Land records by ``brand`` and ``dt``; only the partitions present in ``df`` are replaced.

    Rebalancing keeps files of a partition together and still cuts a busy
    brand and day into tasks of the advisory size.
    """
    (
        df.hint("rebalance", "brand", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("brand", "dt")
        .format(fmt)
        .save(root)
    )


def truncate_tables(spark: SparkSession, paths: Sequence[str]) -> None:
    """Empty tables, keeping their columns."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
