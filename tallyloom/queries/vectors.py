"""Vector search, fusion and hydration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions import vectors as VF
from tallyloom.operators import joins as J
from tallyloom.operators import vector_search as V
from tallyloom.plans import domain as D
from tallyloom.plans import search as S
from tallyloom.plans.domain import ITEMS_SQL, OFFERS_SQL, PRODUCTS_SQL, with_
from tallyloom.queries import register
from tallyloom.queries.offers import MALL_SQL, RANKED_SQL
from tallyloom.session import scratch_path

# One query per (label, last digit): the group's first vector as image, its last as text.
ASKED_SQL = """asked AS (
  SELECT label * 10 + vec_id % 10 AS query_id, arg_min(embedding, vec_id) AS image_vector, list_reverse(arg_max(embedding, vec_id)) AS text_vector,
         CASE WHEN any_value(label) % 2 = 0 THEN ['cat0', 'cat1'] END AS category, CASE WHEN any_value(label) % 5 = 0 THEN ['women'] END AS gender
  FROM embeddings GROUP BY 1, label)"""


def asked(spark, d):
    e = D.table(spark, d, "embeddings")
    return e.groupBy((F.col("label") * 10 + F.col("vec_id") % 10).alias("query_id"), "label").agg(
        F.min_by("embedding", "vec_id").alias("image_vector"), F.reverse(F.max_by("embedding", "vec_id")).alias("text_vector")
    ).select(
        "query_id",
        "image_vector",
        "text_vector",
        F.when(F.col("label") % 2 == 0, F.array(F.lit("cat0"), F.lit("cat1"))).alias("category"),
        F.when(F.col("label") % 5 == 0, F.array(F.lit("women"))).alias("gender"),
    )


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


FILTERS = "(q.category IS NULL OR list_contains(q.category, i.category)) AND (q.gender IS NULL OR list_contains(q.gender, i.gender))"


def hits_sql(name: str, field: str, k: int, where: str = FILTERS, extra: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
  SELECT q.query_id, i.id, {cosine(f"q.{field}", f"i.{field}")} AS score FROM asked q JOIN items i ON {where} {extra}
  WHERE i.{field} IS NOT NULL AND q.{field} IS NOT NULL)) WHERE rank <= {k})"""


def rounded(hits):
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


ROUNDED = "SELECT query_id, id, round(score, 6) AS score, rank FROM "


def image_queries(spark, d):
    return asked(spark, d).select("query_id", F.col("image_vector").alias("vector"), "category", "gender")


@register("knn_image", with_(ITEMS_SQL, ASKED_SQL, hits_sql("hits", "image_vector", 20)) + ROUNDED + "hits")
def knn_image(spark, d):
    return rounded(V.knn(D.items(spark, d), image_queries(spark, d), "image_vector", 20, ("category", "gender")))


@register("knn_text", with_(ITEMS_SQL, ASKED_SQL, hits_sql("hits", "text_vector", 10, "i.gender = 'men'")) + ROUNDED + "hits")
def knn_text(spark, d):
    """One condition for all queries, which the scan takes; items without a text vector drop out."""
    queries = asked(spark, d).select("query_id", F.col("text_vector").alias("vector"))
    return rounded(V.knn(D.items(spark, d), queries, "text_vector", 10, condition=F.col("gender") == "men"))


@register("knn_grid", with_(ITEMS_SQL, ASKED_SQL, hits_sql("hits", "image_vector", 20)) + ROUNDED + "hits")
def knn_grid(spark, d):
    """Small cells, so that many meet."""
    return rounded(
        V.knn(D.items(spark, d), image_queries(spark, d), "image_vector", 20, ("category", "gender"), cell=(40, 150))
    )


def inverted_file(spark, d):
    return V.build_inverted_file(D.items(spark, d), "image_vector", scratch_path(spark, "cells"), ("category", "gender"))


@register("knn_inverted_file")
def knn_inverted_file(spark, d):
    return rounded(V.knn_inverted_file(inverted_file(spark, d), image_queries(spark, d), 10))


@register("knn_inverted_file_recall", with_(ASKED_SQL) + "SELECT count(*) AS queries, TRUE AS good, TRUE AS complete FROM asked")
def knn_inverted_file_recall(spark, d):
    """Held against the exact search: at least nine in ten of all hits found, and k hits for every query that has them."""
    found = V.knn_inverted_file(inverted_file(spark, d), image_queries(spark, d), 10).select("query_id", "id", F.lit(1).alias("found"))
    exact = V.knn(D.items(spark, d), image_queries(spark, d), "image_vector", 10, ("category", "gender"))
    both = exact.select("query_id", "id", F.lit(1).alias("wanted")).join(found, ["query_id", "id"], "full_outer")
    per = both.groupBy("query_id").agg(F.count("wanted").alias("wanted"), F.count("found").alias("found"), F.count(F.col("wanted") + F.col("found")).alias("both"))
    return per.agg(
        F.count("*").alias("queries"), (F.sum("both") >= 0.9 * F.sum("wanted")).alias("good"), F.bool_and(F.col("found") == F.col("wanted")).alias("complete")
    )


IMAGE_HITS = hits_sql("image_hits", "image_vector", 30)
TEXT_HITS = hits_sql("text_hits", "text_vector", 30)


def both_hits(spark, d, k=30):
    items, queries = D.items(spark, d), asked(spark, d)
    names = ("category", "gender")

    def ask(field):
        return V.knn(items, queries.select("query_id", F.col(field).alias("vector"), *names), field, k, names)

    return ask("image_vector"), ask("text_vector")


RRF_SQL = """fused AS (SELECT query_id, id, coalesce(0.7::DOUBLE * (1.0::DOUBLE / (60 + a.rank)), 0) + coalesce(0.3::DOUBLE * (1.0::DOUBLE / (60 + b.rank)), 0) AS score
  FROM image_hits a FULL OUTER JOIN text_hits b USING (query_id, id))"""


@register("fuse_rrf", with_(ITEMS_SQL, ASKED_SQL, IMAGE_HITS, TEXT_HITS, RRF_SQL) + "SELECT query_id, id, round(score, 9) AS score FROM fused")
def fuse_rrf(spark, d):
    return V.fuse_rrf(*both_hits(spark, d)).withColumn("score", F.round("score", 9))


MINMAX_SQL = """scaled_a AS (SELECT query_id, id, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM image_hits WINDOW w AS (PARTITION BY query_id))),
scaled_b AS (SELECT query_id, id, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM text_hits WINDOW w AS (PARTITION BY query_id))),
fused AS (SELECT query_id, id, 0.7::DOUBLE * coalesce(a.s, 0) + 0.3::DOUBLE * coalesce(b.s, 0) AS score FROM scaled_a a FULL OUTER JOIN scaled_b b USING (query_id, id))"""


@register("fuse_minmax", with_(ITEMS_SQL, ASKED_SQL, IMAGE_HITS, TEXT_HITS, MINMAX_SQL) + "SELECT query_id, id, round(score, 6) AS score FROM fused")
def fuse_minmax(spark, d):
    return V.fuse_minmax(*both_hits(spark, d)).withColumn("score", F.round("score", 6))


# Modes: a third of the queries each has only an image, only a text, or both.
MODES_SQL = ASKED_SQL.replace("asked AS", "asked_all AS", 1) + """,
asked AS (SELECT query_id, CASE WHEN query_id % 3 <> 1 THEN image_vector END AS image_vector,
  CASE WHEN query_id % 3 <> 0 THEN text_vector END AS text_vector, category, gender FROM asked_all)"""


def search_sql(fuse: str) -> str:
    return with_(
        ITEMS_SQL,
        MODES_SQL,
        hits_sql("by_image", "image_vector", 300),
        hits_sql("by_text", "text_vector", 6, FILTERS + " AND q.image_vector IS NULL"),
        "image_hits AS (SELECT h.* FROM by_image h JOIN asked q USING (query_id) WHERE q.text_vector IS NOT NULL)",
        hits_sql("text_hits", "text_vector", 300, "TRUE", "JOIN image_hits c ON c.query_id = q.query_id AND c.id = i.id"),
        fuse,
        """found AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused
  UNION ALL SELECT h.* FROM by_image h JOIN asked q USING (query_id) WHERE q.text_vector IS NULL UNION ALL SELECT * FROM by_text)""",
    )


def mixed(spark, d):
    key = F.col("query_id") % 3
    return (
        asked(spark, d)
        .withColumn("image_vector", F.when(key != 1, F.col("image_vector")))
        .withColumn("text_vector", F.when(key != 0, F.col("text_vector")))
    )


@register("search", search_sql(RRF_SQL) + ROUNDED + "found WHERE rank <= 6")
def search(spark, d):
    return rounded(V.search(D.items(spark, d), mixed(spark, d)))


@register("search_minmax", search_sql(MINMAX_SQL) + ROUNDED + "found WHERE rank <= 6")
def search_minmax(spark, d):
    return rounded(V.search(D.items(spark, d), mixed(spark, d), fusion="minmax"))


@register(
    "restrict_candidates",
    with_(ITEMS_SQL, ASKED_SQL, hits_sql("hits", "image_vector", 5)) + "SELECT id, category, gender FROM items WHERE id IN (SELECT id FROM hits)",
)
def restrict_candidates(spark, d):
    items = D.items(spark, d)
    hits = V.knn(items, image_queries(spark, d), "image_vector", 5, ("category", "gender"))
    return J.restrict_candidates(items.select("id", "category", "gender"), hits)


@register(
    "score_map",
    with_(ITEMS_SQL, ASKED_SQL, hits_sql("hits", "image_vector", 6))
    + "SELECT query_id, count(*) AS entries, string_agg(id, ',' ORDER BY id) AS ids, round(sum(round(score, 6)), 6) AS total FROM hits GROUP BY 1",
)
def score_map(spark, d):
    maps = V.score_map(V.knn(D.items(spark, d), image_queries(spark, d), "image_vector", 6, ("category", "gender")))
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return maps.select(
        "query_id",
        F.size("scores").cast("long").alias("entries"),
        F.array_join(F.array_sort(F.map_keys("scores")), ",").alias("ids"),
        F.round(total, 6).alias("total"),
    )


# Every third supplier has neither a name nor an address.
NAMELESS_SQL = OFFERS_SQL.replace("concat('mall', CAST(l_suppkey AS VARCHAR))", "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('mall', CAST(l_suppkey AS VARCHAR)) END").replace(
    "concat('https://mall/', CAST(l_suppkey AS VARCHAR))", "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat('https://mall/', CAST(l_suppkey AS VARCHAR)) END"
)


def nameless_offers(spark, d):
    named = F.substring_index("mall_url", "/", -1).cast("long") % 3 != 0
    offers = D.offers(spark, d).withColumn("__named", named)
    shown = [F.when(F.col("__named"), F.col(c)).otherwise("").alias(c) for c in ("mall_name", "mall_url")]
    return offers.select("offer_id", "product_id", "price", *shown)


PLACEHOLDER = "https://placehold.co/300x300?text=No+Image"
HYDRATE_SQL = f"""hydrated AS (
  SELECT query_id, p.product_id, prod_name, brand_name, coalesce(r.price, base_price) AS price,
    coalesce(CASE WHEN starts_with(img_hdfs_path, '/') THEN img_hdfs_path ELSE '/' || img_hdfs_path END, '{PLACEHOLDER}') AS image_url,
    coalesce(nullif(r.mall_name, ''), '공식몰') AS mall_name, coalesce(nullif(r.mall_url, ''), '#') AS mall_url, round(score, 4) AS similarity_score, 'vector' AS search_source
  FROM scores s JOIN products p ON s.id = p.product_id AND p.gender = 'men' LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.product_id = p.product_id),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, product_id DESC) AS INTEGER) AS rank FROM hydrated) WHERE rank <= 6)"""


@register(
    "hydrate_scores",
    with_(ITEMS_SQL, ASKED_SQL, hits_sql("scores", "image_vector", 20), PRODUCTS_SQL, NAMELESS_SQL, MALL_SQL, RANKED_SQL, HYDRATE_SQL)
    + "SELECT * FROM best",
)
def hydrate_scores(spark, d):
    hits = V.knn(D.items(spark, d), image_queries(spark, d), "image_vector", 20, ("category", "gender"))
    return J.hydrate_scores(hits.drop("rank"), D.products(spark, d), nameless_offers(spark, d), F.col("gender") == "men")


SPARE_SQL = f"""spare AS (SELECT p.product_id, prod_name, brand_name, coalesce(r.price, base_price) AS price,
    coalesce(CASE WHEN starts_with(img_hdfs_path, '/') THEN img_hdfs_path ELSE '/' || img_hdfs_path END, '{PLACEHOLDER}') AS image_url,
    coalesce(nullif(r.mall_name, ''), '공식몰') AS mall_name, coalesce(nullif(r.mall_url, ''), '#') AS mall_url
  FROM (SELECT * FROM products WHERE gender = 'men' ORDER BY md5('0#' || product_id), product_id LIMIT 6) p
  LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.product_id = p.product_id)"""


@register(
    "search_and_hydrate",
    search_sql(RRF_SQL).rstrip()
    + ",\n"
    + ",\n".join(["scores AS (SELECT * FROM found WHERE rank <= 6)", PRODUCTS_SQL, NAMELESS_SQL, MALL_SQL, RANKED_SQL, HYDRATE_SQL, SPARE_SQL])
    + """
SELECT * FROM best
UNION ALL BY NAME
SELECT query_id, s.*, NULL::DOUBLE AS similarity_score, 'fallback' AS search_source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS INTEGER) AS rank
FROM asked, spare s WHERE query_id NOT IN (SELECT query_id FROM best)""",
)
def search_and_hydrate(spark, d):
    return S.search_and_hydrate(
        D.items(spark, d), mixed(spark, d), D.products(spark, d), nameless_offers(spark, d), condition=F.col("gender") == "men"
    )


@register(
    "search_log",
    search_sql(RRF_SQL)
    + """SELECT q.query_id, 1000 + row_number() OVER (ORDER BY q.query_id) AS log_id, coalesce(n, 6) AS result_count, 'completed' AS search_status
FROM asked q LEFT JOIN (SELECT query_id, count(*) AS n FROM found JOIN part ON id = CAST(p_partkey AS VARCHAR) WHERE rank <= 6 GROUP BY 1) USING (query_id)""",
)
def search_log(spark, d):
    queries = mixed(spark, d)
    hydrated = S.search_and_hydrate(queries=queries, items=D.items(spark, d), products=D.products(spark, d), offers=nameless_offers(spark, d))
    return S.log_search(queries.select("query_id"), hydrated, last_id=1000)[0]


@register(
    "keyword_search",
    with_(PRODUCTS_SQL)
    + """SELECT product_id, prod_name, base_price, img_hdfs_path FROM products
WHERE prod_name ILIKE '%plate%' AND gender = 'men' AND lower(category_code) IN ('promo', 'large') ORDER BY product_id DESC LIMIT 50""",
)
def keyword_search(spark, d):
    return V.keyword_search(D.products(spark, d), "PLATE", ["promo", "large"], "Men", top_k=50)


@register(
    "text_match_fields",
    """SELECT p_partkey, CAST(len(list_intersect(list_distinct(string_split_regex(trim(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^가-힣a-zA-Z0-9]+', ' ', 'g')), '\\s+')), ['red', 'ring', 'promo', '17'])) AS INTEGER) AS score
FROM part WHERE score > 0""",
)
def text_match_fields(spark, d):
    found = V.text_match(D.table(spark, d, "part"), ["Red", "ring", "PROMO", "17", "red"], ["p_name", "p_brand", "p_type"])
    return found.select("p_partkey", "score")


@register(
    "l2_normalize",
    """SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 6) AS norm_before,
  CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm_after
FROM (SELECT vec_id, [CAST(x AS DOUBLE) * (vec_id % 10) FOR x IN embedding] AS v FROM embeddings)""",
)
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 10))
    rows = D.table(spark, d, "embeddings").select("vec_id", scaled.alias("v"))
    return rows.select(
        "vec_id", F.round(VF.norm(F.col("v")), 6).alias("norm_before"), F.round(VF.norm(VF.l2_normalize(F.col("v"))), 6).alias("norm_after")
    )


@register(
    "validate_dims",
    """WITH t AS (SELECT vec_id, embedding AS image_vector, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN [] WHEN vec_id % 11 = 0 THEN embedding[1:10] ELSE embedding END AS text_vector FROM embeddings),
u AS (SELECT 'image_vector' AS field, image_vector AS v FROM t UNION ALL SELECT 'text_vector', text_vector FROM t)
SELECT field, count(*) FILTER (WHERE v IS NULL) AS absent, count(*) FILTER (WHERE len(v) = 0) AS invalid, count(*) FILTER (WHERE len(v) > 0) AS present,
  CAST(min(nullif(len(v), 0)) AS INTEGER) AS min_dims, CAST(max(nullif(len(v), 0)) AS INTEGER) AS max_dims,
  count(*) FILTER (WHERE len(v) = 0) = 0 AND min(nullif(len(v), 0)) = max(nullif(len(v), 0)) AS "valid"
FROM u GROUP BY 1""",
)
def validate_dims(spark, d):
    key, e = F.col("vec_id"), F.col("embedding")
    text = (
        F.when(key % 5 == 0, None).when(key % 7 == 0, F.array().cast("array<float>")).when(key % 11 == 0, F.slice(e, 1, 10)).otherwise(e)
    )
    docs = D.table(spark, d, "embeddings").select("vec_id", e.alias("image_vector"), text.alias("text_vector"))
    return VF.validate_dims(docs, VF.detect_vector_fields(docs.schema))


@register(
    "items_with_field",
    with_(ITEMS_SQL) + "SELECT id, category FROM items WHERE text_vector IS NOT NULL",
)
def items_with_field(spark, d):
    return D.items(spark, d).filter(P.exists_field(F.col("text_vector"))).select("id", "category")
