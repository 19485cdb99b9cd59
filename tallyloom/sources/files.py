"""Readers for raw records, documents, catalog files, images and log text."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import constants as C
from tallyloom.functions.catalog import price_or_zero

# One shape for all sources; columns a source lacks read as NULL.
RAW_SCHEMA = (
    "goodsNo string, product_code string, display_goods_no string, goodsNm string, brandName string, price string, "
    "thumbnailImageUrl string, url string, scraped_url string, goodsImages array<string>, detailImages array<string>, "
    "goodsMaterial map<string,string>, is_sold_out boolean, "
    "size_stock array<struct<size:string,is_sold_out:boolean,stock_qty:int>>, "
    "colors array<struct<color_code:string,color_name:string,icon_url:string>>, other_color_ids array<string>, "
    "sizeChart array<map<string,string>>, error string, scraped_at string"
)

CATALOG_TEXT_COLUMNS = (
    "model_code", "prod_name", "category_code", "img_hdfs_path", "brand_name", "gender", "origin_url", "create_dt", "update_dt",
)


def read_raw_json(spark: SparkSession, path: str | Sequence[str], schema: str = RAW_SCHEMA) -> DataFrame:
    """Multi-line JSON records with their file path. A given schema saves the inference pass."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def read_partition(spark: SparkSession, root: str, brand: str, date: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """One ``brand``/``dt`` slice of the landing zone; only its folders are listed and read."""
    df = spark.read.schema(schema).option("basePath", root).json(f"{root}/brand={brand}/dt={date}")
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType | str, recursive: bool = True) -> DataFrame:
    """Documents out of a file, a folder or a glob; a file holds one object or an array of them.

    Anything else as the root of a file is an error (FAILFAST).
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    if recursive and not any(c in path for c in "*?["):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return reader.json(path)


def read_json_docs_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same for JSON lines, which split by size: the form to prefer for large collections."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _catalog(df: DataFrame, price: Column, url: Column) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")

    identity = F.substring(F.coalesce(F.col("product_id"), F.lit("")), 1, 20)
    others = [text(c).alias(c) if c != "origin_url" else F.coalesce(url, F.lit("")).alias(c) for c in CATALOG_TEXT_COLUMNS]
    return df.select(identity.alias("product_id"), price.alias("base_price"), *others)


def import_catalog_rows(rows: DataFrame, alias_url: str | None = None) -> DataFrame:
    """Catalog rule on text columns: id cut to 20 characters, price cut to an int, blanks for missing."""
    price = price_or_zero(F.col("base_price")) if "base_price" in rows.columns else F.lit(0)
    names = [n for n in ((alias_url, "origin_url") if alias_url else ("origin_url",)) if n in rows.columns]
    url = F.coalesce(*[F.col(n) for n in names]) if names else F.lit("")
    return _catalog(rows, price, url)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all text; a byte order mark before the first header is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def import_catalog_csv(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Catalog rows of a CSV file, one per id, without ids that exist already."""
    return new_ids(import_catalog_rows(read_catalog_csv(spark, path)), existing)


def import_catalog_json(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Fallback for a missing CSV; the url may come under its misspelt name ``origine_url``."""
    names = ("product_id", "base_price", *CATALOG_TEXT_COLUMNS, "origine_url")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return new_ids(import_catalog_rows(docs, alias_url="origine_url"), existing)


def new_ids(rows: DataFrame, existing: DataFrame | None, key: str = "product_id") -> DataFrame:
    """Insert-ignore on the id: known ids and repeats are left out."""
    once = rows.dropDuplicates([key])
    return once if existing is None else once.join(existing.select(key), key, "left_anti")


def cut_ids(rows: DataFrame, length: int = 20, key: str = "product_id") -> DataFrame:
    """(id, originals): ids that several longer ones become when cut, which an import folds into one."""
    cut = F.substring(F.coalesce(F.col(key), F.lit("")), 1, length)
    pairs = rows.select(cut.alias("id"), F.col(key).alias("original")).distinct()
    return pairs.groupBy("id").agg(F.count("original").alias("originals")).filter(F.col("originals") > 1)


def scan_images(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = C.IMAGE_EXTENSIONS,
    min_bytes: int = C.MIN_IMAGE_BYTES,
    with_content: bool = False,
) -> DataFrame:
    """Image files below a root by extension and size; content is only read when asked for."""
    names = ",".join(x for e in extensions for x in (e, e.upper()))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + names + "}")
        .load(root)
        .filter(F.col("length") >= min_bytes)
    )
    columns = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    return files.select(*columns)


def split_tail_line(line: Column, now: Column) -> Column:
    """Struct (timestamp, message) of ``<time> <message>``; nanoseconds are cut to milliseconds.

    A line without a space gets ``now`` (text) and is all message.
    """
    parts = F.split(line, " ", 2)
    two = F.size(parts) == 2
    stamp = F.try_element_at(parts, F.lit(1))
    zulu = F.contains(stamp, F.lit("Z"))
    short = F.concat(F.substring(F.substring_index(stamp, "Z", 1), 1, 23), F.lit("Z"))
    return F.struct(
        F.when(two, F.when(zulu, short).otherwise(stamp)).otherwise(now).alias("timestamp"),
        F.when(two, F.try_element_at(parts, F.lit(2))).otherwise(line).alias("message"),
    )


def read_tail_lines(spark: SparkSession, path: str, now: dt.datetime | None = None) -> DataFrame:
    """Log text, blank lines left out."""
    stamp = F.lit(now.isoformat() + "Z") if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(split_tail_line(F.col("value"), stamp).alias("r"), F.col("value").alias("raw")).select("r.*", "raw")


def column_map(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Per-source projection onto the canonical columns."""
    return df.select(*[c.alias(n) for n, c in columns.items()])
