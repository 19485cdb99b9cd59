"""Domain views over the given tables.

Each view is a projection (plus, for offers with titles, one join) of the
given tables, so its size grows with them. ``*_SQL`` holds the same view as
ANSI SQL; the oracles are built on those, not on the Spark code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.catalog import zero_padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_code() -> Column:
    return F.concat(F.lit("K"), zero_padded(F.col("p_partkey"), 8))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        key.alias("product_id"),
        F.concat(part_code(), F.lit("-"), F.col("p_size").cast("string")).alias("model_code"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_name").alias("prod_name"),
        F.floor("p_retailprice").cast("int").alias("base_price"),
        F.when(F.col("p_size") % 2 == 0, "men").otherwise("women").alias("gender"),
        F.lower("p_type").alias("category_code"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
        .when(F.col("p_size") % 3 == 0, F.concat(F.lit("/img/"), key, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("img/"), key, F.lit(".jpg")))
        .alias("img_hdfs_path"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(p_partkey % 30 as int), p_size % 24, 0, 0)").alias(
            "create_dt"
        ),
    )


PRODUCTS_SQL = """products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         concat(printf('K%08d', p_partkey), '-', CAST(p_size AS VARCHAR)) AS model_code,
         p_brand AS brand_name, p_name AS prod_name,
         CAST(floor(p_retailprice) AS INTEGER) AS base_price,
         CASE WHEN p_size % 2 = 0 THEN 'men' ELSE 'women' END AS gender,
         lower(p_type) AS category_code,
         CASE WHEN p_size % 10 = 0 THEN NULL
              WHEN p_size % 3 = 0 THEN concat('/img/', CAST(p_partkey AS VARCHAR), '.jpg')
              ELSE concat('img/', CAST(p_partkey AS VARCHAR), '.jpg') END AS img_hdfs_path,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 30 AS INTEGER))
           + to_hours(CAST(p_size % 24 AS INTEGER)) AS create_dt
  FROM part)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a marketplace offer; no join, five columns read."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("offer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("int").alias("price"),
        F.concat(F.lit("mall"), F.col("l_suppkey").cast("string")).alias("mall_name"),
        F.concat(F.lit("https://mall/"), F.col("l_suppkey").cast("string")).alias("mall_url"),
    )


OFFERS_SQL = """offers AS (
  SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS offer_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(floor(l_extendedprice / l_quantity) AS INTEGER) AS price,
         concat('mall', CAST(l_suppkey AS VARCHAR)) AS mall_name,
         concat('https://mall/', CAST(l_suppkey AS VARCHAR)) AS mall_url
  FROM lineitem)"""


def staged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results per product and query kind, as a marketplace would return them."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", part_code().alias("code"))
    code = F.col("code")
    order_key, line_number = F.col("l_orderkey"), F.col("l_linenumber")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_brand").alias("brand_name"),
        F.element_at(
            F.array(*[F.lit(k) for k in ("ko_name", "en_name", "ko_code", "en_code")]),
            ((order_key + line_number) % 4 + 1).cast("int"),
        ).alias("kind"),
        (order_key * 10 + line_number).alias("pos"),
        # One id can come back under several kinds; a few items carry no id at all.
        F.when(order_key % 97 == 0, "").otherwise((order_key / 3).cast("long").cast("string")).alias("offer_id"),
        F.when(F.col("l_returnflag") == "A", F.concat("p_brand", F.lit(" <b>"), "p_name", F.lit("</b> "), code))
        .when(F.col("l_returnflag") == "N", F.concat(F.reverse("p_name"), F.lit(" "), F.lower(code), F.lit(" "), "p_brand"))
        .otherwise(F.concat(F.when(line_number % 2 == 0, "중고 ").otherwise(""), "p_name", F.lit(" "), "p_brand"))
        .alias("title"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("int").alias("price"),
        F.concat(F.lit("mall"), F.col("l_suppkey").cast("string")).alias("mall_name"),
        F.concat(F.lit("https://mall/"), F.col("l_suppkey").cast("string")).alias("mall_url"),
    )


STAGED_OFFERS_SQL = """staged AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id,
         list_extract(['ko_name', 'en_name', 'ko_code', 'en_code'], CAST((l_orderkey + l_linenumber) % 4 + 1 AS INTEGER)) AS kind,
         l_orderkey * 10 + l_linenumber AS pos,
         CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE CAST(l_orderkey // 3 AS VARCHAR) END AS offer_id,
         CASE l_returnflag
           WHEN 'A' THEN concat(p_brand, ' <b>', p_name, '</b> ', printf('K%08d', p_partkey))
           WHEN 'N' THEN concat(reverse(p_name), ' ', lower(printf('K%08d', p_partkey)), ' ', p_brand)
           ELSE concat(CASE WHEN l_linenumber % 2 = 0 THEN '중고 ' ELSE '' END, p_name, ' ', p_brand) END AS title,
         CAST(floor(l_extendedprice / l_quantity) AS INTEGER) AS price,
         concat('mall', CAST(l_suppkey AS VARCHAR)) AS mall_name,
         concat('https://mall/', CAST(l_suppkey AS VARCHAR)) AS mall_url
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    service = (F.col("user_id") % 8).cast("string")
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("svc-"), service, F.lit("-main")).alias("container"),
        F.concat(F.lit("svc"), service).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARN")
        .when(F.col("event_type") == "signup", "CRITICAL")
        .otherwise("INFO")
        .alias("level"),
        F.concat("event_type", F.lit(" k="), F.get_json_object("props", "$.k")).alias("message"),
    )


LOGS_SQL = """logs AS (
  SELECT event_id, ts AS "timestamp",
         concat('svc-', CAST(user_id % 8 AS VARCHAR), '-main') AS container,
         concat('svc', CAST(user_id % 8 AS VARCHAR)) AS service,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                         WHEN 'signup' THEN 'CRITICAL' ELSE 'INFO' END AS level,
         concat(event_type, ' k=', json_extract_string(props, '$.k')) AS message
  FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("svc"), (F.col("user_id") % 8).cast("string"), F.lit("-c"), F.col("user_id").cast("string")).alias("container"),
        F.concat(F.lit("svc"), (F.col("user_id") % 8).cast("string")).alias("service"),
        F.round(F.col("value") % 100, 2).alias("cpu_percent"),
        F.round(F.col("value") / 5 % 100, 2).alias("memory_percent"),
        F.floor(F.col("value") * 1048576).cast("long").alias("memory_usage"),
        F.lit(536870912).cast("long").alias("memory_limit"),
    )


METRICS_SQL = """metrics AS (
  SELECT event_id, ts AS "timestamp",
         concat('svc', CAST(user_id % 8 AS VARCHAR), '-c', CAST(user_id AS VARCHAR)) AS container,
         concat('svc', CAST(user_id % 8 AS VARCHAR)) AS service,
         round(value % 100, 2) AS cpu_percent, round(value / 5 % 100, 2) AS memory_percent,
         CAST(floor(value * 1048576) AS BIGINT) AS memory_usage, CAST(536870912 AS BIGINT) AS memory_limit
  FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed items: an image vector, a text vector for most, a category and a gender."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").alias("image_vector"),
        F.when(F.col("vec_id") % 7 != 0, F.reverse("embedding")).alias("text_vector"),
        F.concat(F.lit("cat"), (F.col("label") % 3).cast("string")).alias("category"),
        F.when(F.col("vec_id") % 2 == 0, "men").otherwise("women").alias("gender"),
    )


ITEMS_SQL = """items AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS image_vector,
         CASE WHEN vec_id % 7 <> 0 THEN list_reverse(embedding) END AS text_vector,
         concat('cat', CAST(label % 3 AS VARCHAR)) AS category,
         CASE WHEN vec_id % 2 = 0 THEN 'men' ELSE 'women' END AS gender
  FROM embeddings)"""


def views_and_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, product, action, ts) activity; the product is spread over all parts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.expr("event_id div 5").cast("string").alias("product_id"),
        F.col("event_type").alias("action"),
        F.col("ts").alias("at"),
    )


ACTIVITY_SQL = """activity AS (
  SELECT event_id, concat('u', CAST(user_id AS VARCHAR)) AS user_id,
         CAST(event_id // 5 AS VARCHAR) AS product_id, event_type AS action, ts AS "at"
  FROM events)"""


def with_(*views: str) -> str:
    """``WITH`` clause for the given view texts."""
    return "WITH " + ",\n".join(views) + "\n"
