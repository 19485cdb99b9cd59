"""Catalog load and dense numbering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import sequence as Q
from tallyloom.plans import catalog as P
from tallyloom.plans import domain as D
from tallyloom.plans.domain import with_
from tallyloom.queries import register

SEQ_SQL = """last_seq AS (SELECT p_brand AS brand, max(p_size) * 100 AS last_seq FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1),
numbered AS (SELECT p_partkey, p_brand AS brand, p_size,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) + coalesce(last_seq, 0) AS seq FROM part LEFT JOIN last_seq ON p_brand = brand)"""


def numbered(spark, d):
    part = D.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), "p_size")
    stored = part.filter(F.col("brand") != "Brand#3").groupBy("brand").agg((F.max("p_size") * 100).alias("last_seq"))
    return Q.assign_sequence(part, ["p_size", "p_partkey"], "brand", stored)


@register("assign_sequence", with_(SEQ_SQL) + "SELECT * FROM numbered")
def assign_sequence(spark, d):
    return numbered(spark, d)


@register("next_sequences", with_(SEQ_SQL) + "SELECT brand, max(seq) AS last_seq FROM numbered GROUP BY 1")
def next_sequences(spark, d):
    return Q.next_sequences(numbered(spark, d), "brand")


@register(
    "assign_sequence_overall",
    "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey) AS seq FROM lineitem",
)
def assign_sequence_overall(spark, d):
    """All rows in one order that starts with a hot value."""
    line = D.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    return Q.assign_sequence(line, ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"]).drop("l_returnflag")


# The catalog's parts, dealt to the five sources; codes are shared by many records.
RAW_SQL = """raw AS (SELECT p_partkey, list_extract(['8seconds', 'musinsa', 'topten', 'uniqlo', 'zara'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS brand,
  'G' || CAST(p_size AS VARCHAR) AS code, p_name, p_type, p_size, p_retailprice, CASE WHEN p_size % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'S' || CAST(p_partkey AS VARCHAR) END AS alt FROM part),
attrs AS (SELECT *, '/raw/' || brand || '/' || brand || '_' || gender || '_' || p_type || '_' || CAST(p_partkey AS VARCHAR) || '.json' AS file_path,
  CASE WHEN brand IN ('musinsa', 'uniqlo') THEN gender ELSE lower(gender) END AS g,
  CASE WHEN brand IN ('musinsa', 'uniqlo') THEN p_type ELSE lower(p_type) END AS sub FROM raw)"""


def raw_records(spark, d):
    key = F.col("p_partkey").cast("string")
    brands = F.array(*[F.lit(s.brand) for s in P.SOURCES])
    brand = F.element_at(brands, (F.col("p_partkey") % 5 + 1).cast("int"))
    gender = F.when(F.col("p_size") % 2 == 0, "Men").otherwise("Women")
    alternative = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("S"), key))
    return D.table(spark, d, "part").select(
        brand.alias("brand"),
        F.concat(F.lit("G"), F.col("p_size").cast("string")).alias("goodsNo"),
        alternative.alias("product_code"),
        alternative.alias("display_goods_no"),
        F.col("p_name").alias("goodsNm"),
        F.when(F.col("p_size") % 7 == 0, "12,000").otherwise(F.floor("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("t"), key)).alias("thumbnailImageUrl"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("u"), key)).alias("url"),
        F.concat(F.lit("s"), key).alias("scraped_url"),
        F.slice(F.array(*[F.concat(F.lit(f"i{i}-"), key) for i in range(1, 6)]), F.lit(1), F.col("p_size") % 6).alias("goodsImages"),
        F.create_map(F.lit("배송 안내"), F.lit("x"), F.lit("소재"), F.col("p_name")).alias("goodsMaterial"),
        F.concat(
            F.lit("/raw/"), brand, F.lit("/"), brand, F.lit("_"), gender, F.lit("_"), "p_type", F.lit("_"), key, F.lit(".json")
        ).alias("file_path"),
    )


PREFIX_SQL = "CASE brand WHEN '8seconds' THEN '8S' WHEN 'musinsa' THEN 'MS' WHEN 'topten' THEN 'TT' WHEN 'uniqlo' THEN 'UQ' ELSE 'ZR' END"
LOAD_SQL = with_(RAW_SQL) + f"""SELECT {PREFIX_SQL} || printf('%04d', row_number() OVER (PARTITION BY brand ORDER BY code, file_path) + CASE WHEN brand = 'zara' THEN 9990 ELSE 0 END) AS product_id,
  upper(brand) AS brand_name, CASE WHEN brand IN ('musinsa', 'uniqlo') THEN coalesce(alt, code) ELSE code END AS model_code, p_name AS prod_name,
  CASE WHEN p_size % 7 = 0 THEN 0 ELSE CAST(floor(p_retailprice) AS INTEGER) END AS base_price, g AS gender,
  CASE WHEN brand = 'topten' THEN g || '_' || sub ELSE sub END AS category_code,
  '/raw/' || brand || '/image/' || brand || '_' || g || '_' || sub || '_' || code || '.jpg' AS img_hdfs_path,
  CASE brand WHEN 'zara' THEN 'https://www.zara.com/kr/ko/share/-p' || code || '.html'
    ELSE coalesce(CASE WHEN p_size % 5 <> 0 THEN 'u' || CAST(p_partkey AS VARCHAR) END, CASE WHEN brand IN ('musinsa', 'uniqlo') THEN 's' || CAST(p_partkey AS VARCHAR) END) END AS origin_url,
  CASE brand WHEN 'musinsa' THEN CASE WHEN p_size % 4 <> 0 THEN 't' || CAST(p_partkey AS VARCHAR) END
    WHEN '8seconds' THEN CASE WHEN p_size % 6 >= 3 THEN 'i3-' || CAST(p_partkey AS VARCHAR) END
    WHEN 'zara' THEN CASE WHEN p_size % 4 <> 0 THEN 't' || CAST(p_partkey AS VARCHAR) WHEN p_size % 6 >= 1 THEN 'i1-' || CAST(p_partkey AS VARCHAR) END
    ELSE CASE WHEN p_size % 6 >= 1 THEN 'i1-' || CAST(p_partkey AS VARCHAR) END END AS target_img_url,
  CASE WHEN brand = '8seconds' THEN '{{"소재":"' || p_name || '"}}' ELSE '{{"배송 안내":"x","소재":"' || p_name || '"}}' END AS detail_desc,
  TIMESTAMP '2024-01-31 00:00:00' AS create_dt, TIMESTAMP '2024-01-31 00:00:00' AS update_dt
FROM attrs"""


@register("load_catalog", LOAD_SQL)
def load_catalog(spark, d):
    stored = spark.createDataFrame([("ZARA", 9990)], "brand_name string, last_seq int")
    return P.load_catalog(raw_records(spark, d), stored, as_of=F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz"))[0]
