"""Search to display: vector hits hydrated with products and prices, logged and snapshotted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.operators import joins as J
from tallyloom.operators import vector_search as V
from tallyloom.operators.ranking import random_rows
from tallyloom.operators.sequence import assign_sequence


def search_and_hydrate(
    items: DataFrame,
    queries: DataFrame,
    products: DataFrame,
    offers: DataFrame,
    key: str = "product_id",
    condition: Column | None = None,
    limit: int = C.FINAL_K,
    seed: int = 0,
) -> DataFrame:
    """Hydrated hits per query; a query without any gets ``limit`` products in a seeded random order.

    Every query is given the same ``limit`` spare rows, and keeps them only if
    it has no hit, which is seen within its own few rows: the search runs once.
    """
    hits = V.search(items, queries)
    hydrated = J.hydrate_scores(hits.drop("rank"), products, offers, condition, key, limit)
    spare = random_rows(products if condition is None else products.filter(condition), "product_id", limit, seed)
    shown = ["product_id", "prod_name", "brand_name", "price", "image_url", "mall_name", "mall_url"]
    priced = (
        J.with_cheapest_offer(spare, offers)
        .withColumn("price", F.coalesce("cheapest.price", "base_price"))
        .withColumn("image_url", J.display_path(F.col("img_hdfs_path")))
        .withColumn("mall_name", J.or_default(F.col("cheapest.mall_name"), C.DEFAULT_MALL))
        .withColumn("mall_url", J.or_default(F.col("cheapest.mall_url"), C.DEFAULT_MALL_URL))
    )
    packed = priced.agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("rows"))  # ``limit`` rows
    offered = (
        queries.select("query_id", F.lit(1).alias("__k"))
        .join(F.broadcast(packed.withColumn("__k", F.lit(1))), "__k")
        .select("query_id", F.posexplode("rows").alias("p", "r"))
        .select(
            "query_id",
            "r.*",
            F.lit(None).cast("double").alias("similarity_score"),
            F.lit("fallback").alias("search_source"),
            (F.col("p") + 1).alias("rank"),
        )
    )
    found = F.max(F.col("search_source") != "fallback").over(Window.partitionBy("query_id"))
    return (
        hydrated.unionByName(offered)
        .withColumn("__found", found)
        .filter((F.col("search_source") != "fallback") == F.col("__found"))
        .drop("__found")
    )


def log_search(requests: DataFrame, hydrated: DataFrame, last_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Search log rows, numbered on from ``last_id``, and their ranked result snapshot."""
    counts = hydrated.groupBy("query_id").agg(F.count("*").alias("result_count"))
    numbered = assign_sequence(requests, ["query_id"], name="log_id").withColumn("log_id", F.col("log_id") + last_id)
    log = (
        numbered.join(counts, "query_id", "left")
        .withColumn("result_count", F.coalesce("result_count", F.lit(0)))
        .withColumn("search_status", F.lit("completed"))
    )
    snapshot = hydrated.join(numbered.select("query_id", "log_id"), "query_id").select(
        "log_id",
        "rank",
        F.col("prod_name").alias("product_name"),
        F.col("brand_name").alias("brand"),
        "price",
        "image_url",
        "mall_name",
        "mall_url",
    )
    return log, snapshot
