"""Listings, feeds, boards, sets, detections, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.operators import aggregates as A
from tallyloom.operators import joins as J
from tallyloom.operators import keyed as K
from tallyloom.operators import ranking as R
from tallyloom.operators import sets as S
from tallyloom.plans import domain as D
from tallyloom.plans.domain import ACTIVITY_SQL, OFFERS_SQL, PRODUCTS_SQL, with_
from tallyloom.queries import register
from tallyloom.queries.offers import MALL_SQL, RANKED_SQL

FEED = """SELECT product_id, prod_name, brand_name, base_price, coalesce(r.price, base_price) AS lowest_price, r.mall_name, "at"
FROM mine JOIN products p USING (product_id) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (product_id)
ORDER BY "at" DESC, product_id LIMIT 20"""
FEED_COLUMNS = ("product_id", "prod_name", "brand_name", "base_price", "lowest_price", "mall_name", "at")


@register(
    "recent_views_feed",
    with_(PRODUCTS_SQL, OFFERS_SQL, MALL_SQL, RANKED_SQL, ACTIVITY_SQL, """mine AS (SELECT product_id, max("at") AS "at" FROM activity WHERE action = 'view' AND user_id = 'u7' GROUP BY 1)""")
    + FEED,
)
def recent_views_feed(spark, d):
    views = K.touch_latest(D.views_and_likes(spark, d).filter(F.col("action") == "view"), ["user_id", "product_id"])
    return J.activity_feed(views, D.products(spark, d), D.offers(spark, d), "u7").select(*FEED_COLUMNS)


@register(
    "likes_feed",
    with_(
        PRODUCTS_SQL, OFFERS_SQL, MALL_SQL, RANKED_SQL, ACTIVITY_SQL,
        """mine AS (SELECT product_id, max("at") AS "at" FROM activity WHERE action IN ('click', 'error') AND user_id = 'u9' GROUP BY 1 HAVING arg_max(action, event_id) = 'click')""",
    )
    + FEED,
)
def likes_feed(spark, d):
    clicks = D.views_and_likes(spark, d).filter(F.col("action").isin("click", "error"))
    likes = K.toggle_state(clicks, ["user_id", "product_id"], "click")
    return J.activity_feed(likes, D.products(spark, d), D.offers(spark, d), "u9").select(*FEED_COLUMNS)


# Board: orders are posts, customers are users, line items are comments.
def board(spark, d):
    posts = D.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("create_dt")
    )
    users = D.table(spark, d, "customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("author_name")
    )
    comments = D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").alias("comment_id"),
        F.col("l_suppkey").alias("author_id"),
        F.col("l_shipdate").alias("comment_dt"),
    )
    return posts, users, comments


BOARD_SQL = """WITH users AS (SELECT c_custkey AS user_id, c_name AS author_name FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT o_orderkey AS post_id, o_custkey AS author_id, o_orderdate AS create_dt, author_name, coalesce(n, 0) AS comment_count
FROM orders LEFT JOIN users ON o_custkey = user_id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


@register("board_with_counts", BOARD_SQL)
def board_with_counts(spark, d):
    return J.board_with_counts(*board(spark, d))


@register("board_page", BOARD_SQL + " ORDER BY create_dt DESC, post_id DESC LIMIT 20 OFFSET 40")
def board_page(spark, d):
    rows = J.board_with_counts(*board(spark, d))
    return R.page(rows, [F.desc("create_dt"), F.desc("post_id")], number=3, size=20)


@register(
    "thread_comments",
    """WITH users AS (SELECT c_custkey AS user_id, c_name AS author_name FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT l_orderkey AS post_id, l_linenumber AS comment_id, l_suppkey AS author_id, author_name, l_shipdate AS comment_dt,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_suppkey) AS INTEGER) AS position
FROM lineitem LEFT JOIN users ON l_suppkey = user_id""",
)
def thread_comments(spark, d):
    from pyspark.sql import Window

    _, users, comments = board(spark, d)
    oldest_first = Window.partitionBy("post_id").orderBy("comment_dt", "comment_id", "author_id")
    return J.thread_comments(comments, users).withColumn("position", F.row_number().over(oldest_first))


@register(
    "page_meta",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, CAST(3 AS BIGINT) AS page FROM orders WHERE o_custkey = 7",
)
def page_meta(spark, d):
    return A.page_meta(D.table(spark, d, "orders").filter(F.col("o_custkey") == 7), offset=40, size=20)


@register(
    "product_listing_page",
    with_(PRODUCTS_SQL) + "SELECT product_id, model_code, prod_name, base_price, category_code FROM products WHERE prod_name ILIKE '%ring%' ORDER BY product_id DESC LIMIT 10 OFFSET 10",
)
def product_listing_page(spark, d):
    from tallyloom.functions import predicates as P

    rows = D.products(spark, d).filter(P.contains_text(F.col("prod_name"), "ring"))
    return R.page(rows, [F.desc("product_id")], number=2, size=10).select(
        "product_id", "model_code", "prod_name", "base_price", "category_code"
    )


@register(
    "result_history",
    """SELECT o_orderkey AS log_id, o_orderdate AS create_dt, l_linenumber AS rank, l_extendedprice AS price
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE 'u' || CAST(o_custkey AS VARCHAR) = 'u77'""",
)
def result_history(spark, d):
    log = D.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("log_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("o_orderdate").alias("create_dt"),
    )
    results = D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("log_id"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("price")
    )
    return J.result_history(log, results, "u77").drop("user_id")


@register("key_union", "SELECT doc_id FROM documents UNION SELECT doc_id * 2 FROM labels")
def key_union(spark, d):
    return S.key_union(D.table(spark, d, "documents"), D.table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


@register("key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id * 2 FROM labels")
def key_intersection(spark, d):
    return S.key_intersection(D.table(spark, d, "documents"), D.table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id")


@register("unseen_ids", "SELECT DISTINCT l_partkey * 3 AS id FROM lineitem WHERE l_partkey * 3 NOT IN (SELECT p_partkey FROM part)")
def unseen_ids(spark, d):
    new = D.table(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("id"))
    return S.unseen(new, D.table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id")


@register(
    "union_feeds",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier
UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, NULL, NULL, n_nationkey FROM nation""",
)
def union_feeds(spark, d):
    a = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    b = D.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    c = D.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")
    )
    return S.union_feeds([a, b, c])


@register("distinct_values", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_values(spark, d):
    return A.distinct_values(D.table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@register("random_rows", with_(PRODUCTS_SQL) + "SELECT product_id, prod_name FROM products ORDER BY md5('3#' || product_id), product_id LIMIT 6")
def random_rows(spark, d):
    return R.random_rows(D.products(spark, d), "product_id", 6, seed=3).select("product_id", "prod_name")


@register(
    "log_search_snapshot",
    """WITH t AS (SELECT l_orderkey AS log_id, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem)
SELECT log_id, CAST(l_linenumber AS BIGINT) AS item, l_extendedprice AS price, rank FROM t WHERE rank <= 6""",
)
def log_search_snapshot(spark, d):
    """Orders as searches; the six dearest lines are what each search showed, as one array, then as rows."""
    line = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]
    shown = (
        R.top_per_key(line, ["l_orderkey"], order, C.FINAL_K, "__r")
        .groupBy(F.col("l_orderkey").alias("log_id"))
        .agg(F.sort_array(F.collect_list(F.struct("__r", F.col("l_linenumber").alias("item"), F.col("l_extendedprice").alias("price")))).alias("results"))
    )
    return K.snapshot_results(shown).select("log_id", F.col("item").cast("long").alias("item"), "price", "rank")


# --- detections: part is the catalog, line items are detected boxes ----------

DETECT_SQL = """prods AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category, 'local/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS local_path FROM part),
boxes AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, list_extract(['large', 'Small', 'promo', 'other'], CAST(l_suppkey % 4 + 1 AS INTEGER)) AS category,
  l_discount AS confidence, l_orderkey * 10 + l_linenumber AS pos, 'crop/' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS crop_path FROM lineitem),
matched AS (SELECT b.* FROM boxes b JOIN prods p ON b.product_id = p.product_id AND lower(b.category) = lower(p.category)),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, pos) AS r FROM matched) WHERE r = 1)"""


def detections(spark, d):
    products = D.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("local/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("local_path"),
    )
    kinds = F.array(*[F.lit(k) for k in ("large", "Small", "promo", "other")])
    boxes = D.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("product_id"),
        F.element_at(kinds, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("category"),
        F.col("l_discount").alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("crop/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("crop_path"),
    )
    return products, boxes


@register("match_detections", with_(DETECT_SQL) + "SELECT * FROM matched")
def match_detections(spark, d):
    products, boxes = detections(spark, d)
    return J.match_detections(boxes, products)


@register(
    "boxes_by_confidence",
    with_(DETECT_SQL) + "SELECT product_id, pos, confidence, CAST(row_number() OVER (PARTITION BY product_id ORDER BY confidence DESC, pos) AS INTEGER) AS place FROM boxes",
)
def boxes_by_confidence(spark, d):
    boxes = R.rank_boxes(detections(spark, d)[1], "product_id", "confidence", "pos")
    return boxes.select("product_id", "pos", "confidence", "place")


@register("best_detection", with_(DETECT_SQL) + "SELECT * FROM best")
def best_detection(spark, d):
    products, boxes = detections(spark, d)
    return R.best_detection(J.match_detections(boxes, products), "product_id", "confidence", "pos")


@register(
    "best_detection_or_original",
    with_(DETECT_SQL)
    + "SELECT p.*, coalesce(crop_path, local_path) AS image_path, crop_path IS NOT NULL AS is_cropped FROM prods p LEFT JOIN (SELECT product_id, crop_path FROM best) USING (product_id)",
)
def best_detection_or_original(spark, d):
    products, boxes = detections(spark, d)
    best = R.best_detection(J.match_detections(boxes, products), "product_id", "confidence", "pos")
    return J.best_detection_or_original(products, best)


@register(
    "detection_summary",
    with_(DETECT_SQL)
    + """SELECT (SELECT count(*) FROM prods) AS inputs, (SELECT count(*) FROM boxes) AS raw_detections, (SELECT count(*) FROM best) AS matched,
  (SELECT count(*) FROM prods) - (SELECT count(*) FROM best) AS fallback, (SELECT count(*) FROM prods) AS final_images""",
)
def detection_summary(spark, d):
    products, boxes = detections(spark, d)
    return A.detection_summary(products, boxes, J.match_detections(boxes, products))


@register(
    "clamp_bbox",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 20 - 100 AS x1, CAST(l_quantity AS INTEGER) * 30 AS x2, l_linenumber * 90 - 60 AS y1, l_linenumber * 110 AS y2,
    640 AS width, 480 AS height, l_discount AS conf, list_extract([' Top', 'bottom', '아우터', 'hat'], CAST(l_suppkey % 4 + 1 AS INTEGER)) AS class_name FROM lineitem),
c AS (SELECT *, greatest(0, least(x1, 639)) AS a1, greatest(0, least(x2, 640)) AS a2, greatest(0, least(y1, 479)) AS b1, greatest(0, least(y2, 480)) AS b2 FROM t)
SELECT l_orderkey, l_linenumber, a1 AS x1, a2 AS x2, b1 AS y1, b2 AS y2, a2 - a1 AS w, b2 - b1 AS h,
  CASE trim(class_name) WHEN 'Top' THEN 'Top' WHEN 'bottom' THEN 'Bottom' WHEN '아우터' THEN 'Outer' END AS category,
  CASE trim(class_name) WHEN 'Top' THEN 'Top' WHEN 'bottom' THEN 'Bottom' WHEN '아우터' THEN 'Outer' ELSE class_name END AS label
FROM c WHERE a2 > a1 AND b2 > b1""",
)
def clamp_bbox(spark, d):
    from tallyloom.functions.detection import category_map, clamp_bbox as clamp

    quantity, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    names = F.array(*[F.lit(n) for n in (" Top", "bottom", "아우터", "hat")])
    boxes = D.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (quantity * 20 - 100).alias("x1"),
        (quantity * 30).alias("x2"),
        (line * 90 - 60).alias("y1"),
        (line * 110).alias("y2"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.element_at(names, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("class_name"),
    )
    return clamp(boxes).select(
        "l_orderkey", "l_linenumber", "x1", "x2", "y1", "y2", "w", "h",
        category_map(F.col("class_name")).alias("category"),
        category_map(F.col("class_name"), pass_through=True).alias("label"),
    )
