"""Joins of products, offers, documents and activity.

No broadcast hints on data: Spark broadcasts a side whose size it knows to be
under the threshold, and splits skewed partitions of the others (AQE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions import predicates as P
from tallyloom.session import stored


def with_lowest_price(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with the price and mall of their rank-1 offer, else the base price."""
    first = offers.filter(F.col("rank") == 1).select(
        "product_id", F.col("price").alias("__price"), "mall_name", "mall_url"
    )
    return (
        products.join(first, "product_id", "left")
        .withColumn("lowest_price", F.coalesce("__price", "base_price"))
        .drop("__price")
    )


def with_cheapest_offer(rows: DataFrame, offers: DataFrame, key: str = "product_id") -> DataFrame:
    """Add ``cheapest``, the struct (price, mall_name, mall_url) of each row's cheapest offer, ties by offer id.

    For few rows and many offers: the offers are reduced to those of the rows
    by the join, and only these are folded. ``rows`` holds a key once.
    """
    wanted = rows.select(F.col(key).alias("__key"))
    mine = wanted.join(offers, F.col("__key") == offers["product_id"])
    best = mine.groupBy("__key").agg(F.min_by(F.struct("price", "mall_name", "mall_url"), F.struct("price", "offer_id")).alias("cheapest"))
    return rows.join(best, rows[key] == best["__key"], "left").drop("__key")


def activity_feed(
    activity: DataFrame, products: DataFrame, offers: DataFrame, user_id: str, limit: int = 20, ts: str = "at"
) -> DataFrame:
    """A user's products, newest first, with lowest prices. The user filter reaches the scan.

    The order does not depend on offers, so only the offers of the rows shown are looked at.
    """
    mine = activity.filter(P.owned_by(F.col("user_id"), user_id))
    newest = mine.join(products, "product_id").orderBy(F.desc(ts), F.asc("product_id")).limit(limit)
    priced = with_cheapest_offer(newest, offers).withColumn("lowest_price", F.coalesce("cheapest.price", "base_price"))
    priced = priced.withColumn("mall_name", F.col("cheapest.mall_name")).withColumn("mall_url", F.col("cheapest.mall_url"))
    return priced.drop("cheapest").orderBy(F.desc(ts), F.asc("product_id"))


def tag_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers joined to their product's base price once, tagged clean or anomaly.

    A NULL price or base is in neither set.
    """
    base = products.select("product_id", "base_price")
    price, reference = F.col("price"), F.col("base_price")
    return offers.join(base, "product_id").withColumn(
        "verdict",
        F.when(P.refine_band(price, reference), "clean").when(P.outside_refine_band(price, reference), "anomaly"),
    )


def refine_clean_products(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products with at least one offer inside the band.

    Equal (product, price) pairs are folded before the exchange: a hot product
    joins with its distinct prices only.
    """
    prices = offers.select(F.col("product_id").alias("__pid"), "price").distinct()
    inside = (F.col("product_id") == F.col("__pid")) & P.refine_band(F.col("price"), F.col("base_price"))
    return products.join(prices, inside, "left_semi")


def refine_clean_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    return tag_offers(products, offers).filter(F.col("verdict") == "clean").select(*offers.columns)


def refine_anomalies(products: DataFrame, offers: DataFrame) -> DataFrame:
    return tag_offers(products, offers).filter(F.col("verdict") == "anomaly").select(*offers.columns)


def products_missing_offers(products: DataFrame, offers: DataFrame, newest: int | None = None) -> DataFrame:
    """NOT EXISTS form; ``newest`` keeps the latest N by creation time."""
    missing = products.join(offers.select("product_id"), "product_id", "left_anti")
    return missing if newest is None else missing.orderBy(F.desc("create_dt"), F.asc("product_id")).limit(newest)


def products_not_in_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """NOT IN form: empty as soon as the offers hold a NULL product id.

    A one-row NULL test and an ordinary anti join; the null-aware anti join
    would have to broadcast the offers.
    """
    nulls = offers.filter(F.col("product_id").isNull()).limit(1).agg(F.count("*").alias("__nulls"))
    kept = products.filter(F.col("product_id").isNotNull()).join(offers.select("product_id"), "product_id", "left_anti")
    return kept.join(nulls.filter(F.col("__nulls") > 0), how="left_anti")


def merge_docs(left: DataFrame, right: DataFrame, key: str, how: str = "outer") -> DataFrame:
    """Join documents by key; the right side wins on shared columns, even with NULL."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    only_left = [c for c in left.columns if c not in right.columns]
    only_right = [c for c in right.columns if c not in left.columns]
    a = left.select(key, *only_left, *[F.col(c).alias(f"__left_{c}") for c in shared])
    b = right.withColumn("__right", F.lit(True))
    joined = a.join(b, key, {"outer": "full_outer"}.get(how, how))
    return joined.select(
        key,
        *only_left,
        *[F.when(F.col("__right"), F.col(c)).otherwise(F.col(f"__left_{c}")).alias(c) for c in shared],
        *only_right,
    )


def board_with_counts(posts: DataFrame, users: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with the author's name and number of comments, counted before the join."""
    counts = comments.groupBy("post_id").agg(F.count("*").alias("__n"))
    return (
        posts.join(users, posts.author_id == users.user_id, "left")
        .drop("user_id")
        .join(counts, "post_id", "left")
        .withColumn("comment_count", F.coalesce(F.col("__n"), F.lit(0)))
        .drop("__n")
    )


def thread_comments(comments: DataFrame, users: DataFrame, post: Column | None = None) -> DataFrame:
    """Comments with author names, oldest first within a post."""
    if post is not None:
        comments = comments.filter(post)
    return comments.join(users, comments.author_id == users.user_id, "left").drop("user_id")


def product_detail(products: DataFrame, features: DataFrame, details: DataFrame, offers: DataFrame) -> DataFrame:
    """Product, its features and text, and its ranked offers (at most five) as an array."""
    ranked = (
        offers.filter(F.col("rank") <= C.OFFERS_KEPT)
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "price", "mall_name", "mall_url"))).alias("offers"))
    )
    return (
        products.join(features.select("product_id", "detected_desc"), "product_id", "left")
        .join(details.select("product_id", "detail_desc"), "product_id", "left")
        .join(ranked, "product_id", "left")
    )


def match_detections(detections: DataFrame, products: DataFrame) -> DataFrame:
    """Detections whose category is that of their product, ignoring case."""
    wanted = products.select("product_id", F.lower("category").alias("__category"))
    return (
        detections.withColumn("__category", F.lower("category"))
        .join(wanted, ["product_id", "__category"], "left_semi")
        .drop("__category")
    )


def best_detection_or_original(products: DataFrame, best: DataFrame) -> DataFrame:
    """The crop of the best detection, else the original path; flagged."""
    crops = best.select("product_id", F.col("crop_path").alias("__crop"))
    return (
        products.join(crops, "product_id", "left")
        .withColumn("image_path", F.coalesce("__crop", "local_path"))
        .withColumn("is_cropped", F.col("__crop").isNotNull())
        .drop("__crop")
    )


def restrict_candidates(items: DataFrame, candidates: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    return items.join(candidates.select(*on).distinct(), list(on), "left_semi")


def hydrate_scores(
    scores: DataFrame,
    products: DataFrame,
    offers: DataFrame,
    condition: Column | None = None,
    key: str = "product_id",
    limit: int = C.FINAL_K,
    source: str = "vector",
) -> DataFrame:
    """(query_id, id, score) joined to products and lowest prices; best ``limit`` per query.

    Unknown ids drop out. The best are picked first, which takes no price, and
    only the offers of what is shown are folded to the cheapest. ``key`` is the
    product column the search ids stand for.
    """
    from tallyloom.operators.ranking import top_per_key

    wanted = products if condition is None else products.filter(condition)
    hits = scores.filter(F.col("score").isNotNull()).join(wanted, scores["id"] == wanted[key])
    hits = hits.withColumn("similarity_score", F.round("score", 4))
    # Joined twice below, so kept: ``limit`` rows a query.
    best = stored(top_per_key(hits, ["query_id"], [F.desc("similarity_score"), F.desc("product_id")], limit), "best")
    mine = best.select(F.col("query_id").alias("__q"), F.col("product_id").alias("__p")).join(offers, F.col("__p") == offers["product_id"])
    cheapest = mine.groupBy("__q", "__p").agg(
        F.min_by(F.struct("price", "mall_name", "mall_url"), F.struct("price", "offer_id")).alias("__o")
    )
    priced = best.join(cheapest, (F.col("query_id") == F.col("__q")) & (F.col("product_id") == F.col("__p")), "left")
    return priced.select(
        "query_id",
        "product_id",
        "prod_name",
        "brand_name",
        F.coalesce("__o.price", "base_price").alias("price"),
        display_path(F.col("img_hdfs_path")).alias("image_url"),
        or_default(F.col("__o.mall_name"), C.DEFAULT_MALL).alias("mall_name"),
        or_default(F.col("__o.mall_url"), C.DEFAULT_MALL_URL).alias("mall_url"),
        "similarity_score",
        F.lit(source).alias("search_source"),
        "rank",
    )


def or_default(value: Column, default: str) -> Column:
    """The default also in place of an empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def display_path(path: Column) -> Column:
    """Leading '/' on the image path, a placeholder where there is none."""
    given = F.nullif(path, F.lit(""))
    return F.coalesce(
        F.when(F.startswith(given, F.lit("/")), given).otherwise(F.concat(F.lit("/"), given)),
        F.lit(C.PLACEHOLDER_IMAGE),
    )


def result_history(log: DataFrame, results: DataFrame, user_id: str | None = None) -> DataFrame:
    """Search log rows with their result snapshot, by rank."""
    mine = log if user_id is None else log.filter(P.owned_by(F.col("user_id"), user_id))
    return mine.join(results, "log_id")
