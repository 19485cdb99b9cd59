"""Offer matching, price refinement, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.operators import joins as J
from tallyloom.operators import offers as M
from tallyloom.operators import ranking as R
from tallyloom.plans import domain as D
from tallyloom.plans.domain import OFFERS_SQL, PRODUCTS_SQL, STAGED_OFFERS_SQL, with_
from tallyloom.queries import register
from tallyloom.session import scratch_path
from tallyloom.sources import exports as E

JOINED = "offers o JOIN products p USING (product_id)"
INSIDE = "o.price > p.base_price * 0.4::DOUBLE AND o.price < p.base_price * 2.0::DOUBLE"
OUTSIDE = "(o.price <= p.base_price * 0.4::DOUBLE OR o.price >= p.base_price * 2.0::DOUBLE)"

MALL_SQL = """per_mall AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, mall_name ORDER BY price, offer_id) AS m FROM offers) WHERE m = 1)"""
RANKED_SQL = """ranked AS (
  SELECT product_id, offer_id, price, mall_name, mall_url, rank
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY price, offer_id) AS INTEGER) AS rank FROM per_mall) WHERE rank <= 5)"""


def ranked_offers(spark, d):
    order = [F.col("price"), F.col("offer_id")]
    return R.rank_offers(R.first_per_mall(D.offers(spark, d), ["product_id"], *order), ["product_id"], order)


@register("refine_clean_products", with_(PRODUCTS_SQL, OFFERS_SQL) + f"SELECT p.* FROM products p WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.product_id AND {INSIDE})")
def refine_clean_products(spark, d):
    return J.refine_clean_products(D.products(spark, d), D.offers(spark, d))


@register(
    "refine_clean_products_selective",
    with_(PRODUCTS_SQL, OFFERS_SQL, "dear AS (SELECT product_id, price * 15 AS price FROM offers)")
    + f"SELECT p.product_id, p.base_price FROM products p WHERE EXISTS (SELECT 1 FROM dear o WHERE o.product_id = p.product_id AND {INSIDE})",
)
def refine_clean_products_selective(spark, d):
    """The same over offers priced so that not every product keeps one."""
    products = D.products(spark, d)
    dear = D.offers(spark, d).select("product_id", (F.col("price") * 15).alias("price"))
    return J.refine_clean_products(products, dear).select("product_id", "base_price")


@register("refine_clean_offers", with_(PRODUCTS_SQL, OFFERS_SQL) + f"SELECT o.* FROM {JOINED} WHERE {INSIDE}")
def refine_clean_offers(spark, d):
    return J.refine_clean_offers(D.products(spark, d), D.offers(spark, d))


@register("refine_anomalies", with_(PRODUCTS_SQL, OFFERS_SQL) + f"SELECT o.* FROM {JOINED} WHERE {OUTSIDE}")
def refine_anomalies(spark, d):
    return J.refine_anomalies(D.products(spark, d), D.offers(spark, d))


PARTS_SQL = (
    with_(PRODUCTS_SQL, OFFERS_SQL)
    + f"""SELECT 'offers_clean' AS part, o.offer_id AS id FROM {JOINED} WHERE {INSIDE}
UNION ALL SELECT 'offers_anomaly', o.offer_id FROM {JOINED} WHERE {OUTSIDE}
UNION ALL SELECT 'products_clean', p.product_id FROM products p WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.product_id AND {INSIDE})"""
)


@register("refine_prices", PARTS_SQL)
def refine_prices(spark, d):
    return M.refine_prices(D.products(spark, d), D.offers(spark, d))


@register("publish_refined", PARTS_SQL)
def publish_refined(spark, d):
    """An older version of fewer offers, then the whole one; readers get the newer."""
    root = scratch_path(spark, "refined")
    products, offers = D.products(spark, d), D.offers(spark, d)
    M.publish_refined(products, offers.filter(F.col("price") % 2 == 0), root, "v1")
    M.publish_refined(products, offers, root, "v2")
    current = M.refined_version(spark, root)
    keys = {"offers_clean": "offer_id", "offers_anomaly": "offer_id", "products_clean": "product_id"}
    parts = [current[n].select(F.lit(n).alias("part"), F.col(k).alias("id")) for n, k in keys.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register("first_per_mall", with_(OFFERS_SQL, MALL_SQL) + "SELECT product_id, mall_name, offer_id, price FROM per_mall")
def first_per_mall(spark, d):
    best = R.first_per_mall(D.offers(spark, d), ["product_id"], F.col("price"), F.col("offer_id"))
    return best.select("product_id", "mall_name", "offer_id", "price")


@register("rank_offers", with_(OFFERS_SQL, MALL_SQL, RANKED_SQL) + "SELECT * FROM ranked")
def rank_offers(spark, d):
    return ranked_offers(spark, d).select("product_id", "offer_id", "price", "mall_name", "mall_url", "rank")


@register(
    "with_lowest_price",
    with_(PRODUCTS_SQL, OFFERS_SQL, MALL_SQL, RANKED_SQL)
    + """SELECT p.*, coalesce(r.price, p.base_price) AS lowest_price, r.mall_name, r.mall_url
FROM products p LEFT JOIN ranked r ON p.product_id = r.product_id AND r.rank = 1""",
)
def with_lowest_price(spark, d):
    return J.with_lowest_price(D.products(spark, d), ranked_offers(spark, d))


@register(
    "refined_lowest_prices",
    with_(
        PRODUCTS_SQL,
        OFFERS_SQL.replace("offers AS", "raw_offers AS", 1),
        f"offers AS (SELECT o.* FROM raw_offers o JOIN products p USING (product_id) WHERE {INSIDE})",
        MALL_SQL,
        RANKED_SQL,
    )
    + """SELECT p.product_id, p.prod_name, p.base_price, coalesce(r.price, p.base_price) AS lowest_price, r.mall_name
FROM products p LEFT JOIN ranked r ON p.product_id = r.product_id AND r.rank = 1""",
)
def refined_lowest_prices(spark, d):
    """Flagship: refine, cheapest per mall, rank, join back."""
    products = D.products(spark, d)
    clean = J.refine_clean_offers(products, D.offers(spark, d))
    order = [F.col("price"), F.col("offer_id")]
    ranked = R.rank_offers(R.first_per_mall(clean, ["product_id"], *order), ["product_id"], order)
    return J.with_lowest_price(products, ranked).select("product_id", "prod_name", "base_price", "lowest_price", "mall_name")


# Offers of every second linestatus group only: some products then lack any.
THIN_SQL = "thin AS (SELECT CAST(l_partkey * 2 AS VARCHAR) AS product_id FROM lineitem)"


def thin_offers(spark, d):
    return D.table(spark, d, "lineitem").select((F.col("l_partkey") * 2).cast("string").alias("product_id"))


@register("products_missing_offers", with_(PRODUCTS_SQL, THIN_SQL) + "SELECT product_id FROM products p WHERE NOT EXISTS (SELECT 1 FROM thin t WHERE t.product_id = p.product_id)")
def products_missing_offers(spark, d):
    return J.products_missing_offers(D.products(spark, d), thin_offers(spark, d)).select("product_id")


@register(
    "products_missing_offers_newest",
    with_(PRODUCTS_SQL, THIN_SQL)
    + "SELECT product_id, create_dt FROM products p WHERE NOT EXISTS (SELECT 1 FROM thin t WHERE t.product_id = p.product_id) ORDER BY create_dt DESC, product_id LIMIT 50",
)
def products_missing_offers_newest(spark, d):
    return J.products_missing_offers(D.products(spark, d), thin_offers(spark, d), newest=50).select("product_id", "create_dt")


@register("products_not_in_offers", with_(PRODUCTS_SQL, THIN_SQL) + "SELECT product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM thin)")
def products_not_in_offers(spark, d):
    return J.products_not_in_offers(D.products(spark, d), thin_offers(spark, d)).select("product_id")


# Acceptance as one windowless walk per kind: four stages of filter, anti join and top five.
ACCEPTABLE_SQL = """acceptable AS (
  SELECT product_id, list_position(['ko_name', 'en_name', 'ko_code', 'en_code'], kind) - 1 AS kind_ord, pos, offer_id, id_key, title, price, mall_name, mall_url, similarity
  FROM (
    SELECT *, CASE WHEN a <> '' AND contains(b, a) THEN 1.0::DOUBLE ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS similarity
    FROM (
      SELECT product_id, kind, pos, offer_id, {id_key} AS id_key, t AS title, price, mall_name, mall_url,
             lower(regexp_replace(prod_name, '[^가-힣a-zA-Z0-9]', '', 'g')) AS a, lower(regexp_replace(t, '[^가-힣a-zA-Z0-9]', '', 'g')) AS b,
             contains(lower(replace(t, ' ', '')), lower(split_part(model_code, '-', 1))) AS exact_code, ends_with(kind, '_code') AS is_code
      FROM (SELECT s.*, regexp_replace(s.title, '</?b>', '', 'g') AS t, prod_name, model_code, base_price FROM staged s JOIN products USING (product_id))
      WHERE NOT regexp_matches(t, '구매대행|구제|중고|병행수입') AND price > base_price * 0.3::DOUBLE AND price < base_price * 2.5::DOUBLE))
  WHERE (NOT is_code OR exact_code) AND similarity >= CASE WHEN exact_code THEN 0.175::DOUBLE ELSE 0.35::DOUBLE END)"""


def stage_sql(kind: int) -> str:
    taken = " UNION ALL ".join(f"SELECT product_id, id_key FROM kind{k}" for k in range(kind))
    fresh = (
        f"SELECT a.* FROM acceptable a ANTI JOIN ({taken}) x ON a.product_id = x.product_id AND a.id_key = x.id_key WHERE kind_ord = {kind}"
        if kind
        else "SELECT * FROM acceptable WHERE kind_ord = 0"
    )
    return f"""kind{kind} AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, pos) AS rn FROM (
    SELECT * EXCLUDE (dup) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, id_key ORDER BY price, pos) AS dup FROM ({fresh})) WHERE dup = 1)) WHERE rn <= 5)"""


def matched_sql(id_key: str) -> str:
    return with_(
        PRODUCTS_SQL,
        STAGED_OFFERS_SQL,
        ACCEPTABLE_SQL.replace("{id_key}", id_key),
        *[stage_sql(k) for k in range(4)],
        "pooled AS (" + " UNION ALL ".join(f"SELECT * FROM kind{k}" for k in range(4)) + ")",
        """mall AS (SELECT * EXCLUDE (m) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, mall_name ORDER BY price, kind_ord, pos) AS m FROM pooled) WHERE m = 1)""",
        """matched AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY price, kind_ord, pos) AS INTEGER) AS rank FROM mall) WHERE rank <= 5)""",
    )


V1_KEY = "CASE WHEN offer_id = '' THEN '#' || kind || '#' || CAST(pos AS VARCHAR) ELSE offer_id END"
MATCHED_COLUMNS = "product_id, rank, kind_ord, pos, offer_id, title, price, mall_name, CAST(round(similarity, 2) AS DECIMAL(5, 2)) AS similarity_score"
MATCHED_NAMES = ("product_id", "rank", "kind_ord", "pos", "offer_id", "title", "price", "mall_name", "similarity_score")


@register(
    "accepted_offers",
    matched_sql(V1_KEY) + "SELECT product_id, kind_ord, pos, offer_id, price FROM pooled",
)
def accepted_offers(spark, d):
    out = M.accepted_offers(D.products(spark, d), D.staged_offers(spark, d))
    return out.select("product_id", "kind_ord", "pos", "offer_id", "price")


@register("match_offers", matched_sql(V1_KEY) + f"SELECT {MATCHED_COLUMNS} FROM matched")
def match_offers(spark, d):
    return M.match_offers(D.products(spark, d), D.staged_offers(spark, d)).select(*MATCHED_NAMES)


@register("match_offers_blank_ids_once", matched_sql("offer_id") + f"SELECT {MATCHED_COLUMNS} FROM matched")
def match_offers_blank_ids_once(spark, d):
    out = M.match_offers(D.products(spark, d), D.staged_offers(spark, d), dedupe_blank_ids=True)
    return out.select(*MATCHED_NAMES)


@register(
    "match_offers_fallback",
    with_(STAGED_OFFERS_SQL.replace("CAST(l_partkey AS VARCHAR) AS product_id", "CAST(l_suppkey * 1000 + l_partkey % 50 AS VARCHAR) AS product_id"))
    + """SELECT product_id, pos, price, rank FROM (
  SELECT product_id, pos, price, CAST(row_number() OVER (PARTITION BY product_id ORDER BY price, pos) AS INTEGER) AS rank FROM staged s
  WHERE ends_with(kind, '_code') = EXISTS (SELECT 1 FROM staged c WHERE c.product_id = s.product_id AND ends_with(c.kind, '_code'))) WHERE rank <= 5""",
)
def match_offers_fallback(spark, d):
    """Small groups, so that some have no code result at all."""
    line = D.table(spark, d, "lineitem")
    kind = F.element_at(
        F.array(*[F.lit(k) for k in C.QUERY_KINDS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1).cast("int")
    )
    staged = line.select(
        (F.col("l_suppkey") * 1000 + F.col("l_partkey") % 50).cast("string").alias("product_id"),
        kind.alias("kind"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("int").alias("price"),
    )
    return M.match_offers_fallback(staged).select("product_id", "pos", "price", "rank")


TITLES_SQL = "titles AS (SELECT DISTINCT lower(brand_name) AS brand, title FROM (SELECT p_brand AS brand_name, p_partkey FROM part) JOIN staged ON product_id = CAST(p_partkey AS VARCHAR))"


TEXTS_SQL = """texts AS (SELECT brand, title, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(regexp_replace(title, '</?b>', '', 'g')),
              '[^가-힣a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+'))) AS words FROM titles)"""


@register(
    "candidate_titles",
    with_(STAGED_OFFERS_SQL, TITLES_SQL, "queries AS (SELECT DISTINCT lower(p_brand) AS brand, lower(p_name) AS query FROM part)", TEXTS_SQL)
    + """SELECT * FROM (SELECT q.brand, query, title, CAST(len(list_intersect(string_split(query, ' '), words)) AS INTEGER) AS shared
FROM queries q JOIN texts t ON q.brand = t.brand) WHERE shared >= 1""",
)
def candidate_titles(spark, d):
    return M.candidate_titles(D.products(spark, d), D.staged_offers(spark, d))


@register(
    "candidate_codes",
    with_(STAGED_OFFERS_SQL, TITLES_SQL)
    + """SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS product_id, title FROM part JOIN titles ON lower(p_brand) = brand
WHERE list_contains(string_split_regex(lower(regexp_replace(title, '</?b>', '', 'g')), '\\s+'), lower(printf('K%08d', p_partkey)))""",
)
def candidate_codes(spark, d):
    return M.candidate_codes(D.products(spark, d), D.staged_offers(spark, d))


# A product is offered whatever its phrases find on the market, which is all that is staged.
FOUND_SQL = (
    STAGED_OFFERS_SQL.replace("staged AS", "market AS", 1),
    TITLES_SQL.replace("JOIN staged", "JOIN market"),
    TEXTS_SQL,
    """found AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, brand, title, 'name' AS "by" FROM part JOIN texts ON lower(p_brand) = brand WHERE len(list_intersect(string_split(lower(p_name), ' '), words)) >= 1
  UNION ALL SELECT DISTINCT CAST(p_partkey AS VARCHAR), brand, title, 'code' FROM part JOIN titles ON lower(p_brand) = brand
    WHERE list_contains(string_split_regex(lower(regexp_replace(title, '</?b>', '', 'g')), '\\s+'), lower(printf('K%08d', p_partkey))))""",
    """offered AS (SELECT lower(p_brand) AS brand, m.* FROM market m JOIN part ON m.product_id = CAST(p_partkey AS VARCHAR))""",
    """staged AS (SELECT f.product_id, k.kind, o.* EXCLUDE (product_id, kind, brand) FROM found f JOIN (VALUES ('ko_name', 'name'), ('en_name', 'name'), ('ko_code', 'code'), ('en_code', 'code')) k(kind, "by") ON f."by" = k."by"
  JOIN offered o ON o.brand = f.brand AND o.title = f.title)""",
)


@register("match_offers_from_phrases_whole", matched_sql(V1_KEY).replace(STAGED_OFFERS_SQL, ",\n".join(FOUND_SQL)) + f"SELECT {MATCHED_COLUMNS} FROM matched")
def match_offers_from_phrases_whole(spark, d):
    """From phrases through blocking and gates to the top five, over all staged offers."""
    products = D.products(spark, d)
    return M.match_offers(products, M.staged_from_phrases(products, D.staged_offers(spark, d))).select(*MATCHED_NAMES)


@register(
    "offer_coverage",
    matched_sql(V1_KEY)
    + """SELECT product_id, coalesce(n, 0) AS matched, CASE WHEN coalesce(n, 0) >= 5 THEN 'found' WHEN n > 0 THEN 'short' ELSE 'none' END AS coverage
FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM matched GROUP BY 1) USING (product_id)""",
)
def offer_coverage(spark, d):
    products = D.products(spark, d)
    return M.offer_coverage(products, M.match_offers(products, D.staged_offers(spark, d)))


@register(
    "export_flat_matches",
    matched_sql(V1_KEY)
    + f"""SELECT p.product_id, lower(brand_name) AS brand, model_code, prod_name AS original_name, base_price AS original_price,
  coalesce(CAST(rank AS VARCHAR), '-') AS rank, CASE WHEN rank IS NULL THEN '{C.NO_RESULT}' ELSE title END AS offer_title,
  coalesce(CAST(price AS VARCHAR), '-') AS offer_price, coalesce(mall_name, '-') AS mall_name, coalesce(mall_url, '-') AS mall_url
FROM products p LEFT JOIN matched m USING (product_id)""",
)
def export_flat_matches(spark, d):
    products = D.products(spark, d)
    return E.flat_matches(products, M.match_offers(products, D.staged_offers(spark, d)))


@register(
    "export_nested_matches",
    matched_sql(V1_KEY)
    + """SELECT p.product_id, lower(any_value(brand_name)) AS brand, any_value(base_price) AS original_price, count(rank) AS offers,
  coalesce(string_agg(CAST(rank AS VARCHAR) || ':' || mall_name || '=' || CAST(price AS VARCHAR), ',' ORDER BY rank), '') AS listing
FROM products p LEFT JOIN matched m USING (product_id) GROUP BY p.product_id""",
)
def export_nested_matches(spark, d):
    products = D.products(spark, d)
    docs = E.nested_matches(products, M.match_offers(products, D.staged_offers(spark, d)))
    entry = F.transform(
        "top_5_results",
        lambda o: F.concat(o["final_rank"].cast("string"), F.lit(":"), o["mall_name"], F.lit("="), o["price"].cast("string")),
    )
    return docs.select(
        "product_id",
        F.col("original_info.brand").alias("brand"),
        F.col("original_info.original_price").alias("original_price"),
        F.size("top_5_results").cast("long").alias("offers"),
        F.array_join(entry, ",").alias("listing"),
    )


@register(
    "product_detail",
    with_(PRODUCTS_SQL, OFFERS_SQL, MALL_SQL, RANKED_SQL)
    + """SELECT p.product_id, CASE WHEN p.base_price % 3 <> 0 THEN 'seen ' || p.prod_name END AS detected_desc,
  CASE WHEN p.base_price % 2 = 0 THEN 'long ' || p.category_code END AS detail_desc,
  (SELECT string_agg(CAST(rank AS VARCHAR) || '=' || CAST(price AS VARCHAR), ',' ORDER BY rank) FROM ranked r WHERE r.product_id = p.product_id) AS offers
FROM products p""",
)
def product_detail(spark, d):
    products = D.products(spark, d)
    features = products.filter(F.col("base_price") % 3 != 0).select(
        "product_id", F.concat(F.lit("seen "), "prod_name").alias("detected_desc")
    )
    details = products.filter(F.col("base_price") % 2 == 0).select(
        "product_id", F.concat(F.lit("long "), "category_code").alias("detail_desc")
    )
    detail = J.product_detail(products, features, details, ranked_offers(spark, d))
    entry = F.transform("offers", lambda o: F.concat(o["rank"].cast("string"), F.lit("="), o["price"].cast("string")))
    return detail.select("product_id", "detected_desc", "detail_desc", F.array_join(entry, ",").alias("offers"))
