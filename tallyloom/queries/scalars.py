"""Column functions and predicates, several columns per query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions import catalog as G
from tallyloom.functions import constants as C
from tallyloom.functions import logs as L
from tallyloom.functions import predicates as P
from tallyloom.functions import text as X
from tallyloom.plans import domain as D
from tallyloom.plans.domain import LOGS_SQL, OFFERS_SQL, PRODUCTS_SQL, STAGED_OFFERS_SQL, table, with_
from tallyloom.queries import register


def sql_in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


PATHS_SQL = """paths AS (
  SELECT p_partkey, p_type, p_size, p_retailprice,
         CASE WHEN p_partkey % 11 = 0 THEN concat('/raw/other/', CAST(p_partkey AS VARCHAR), '.json')
              ELSE concat('/raw/zara/zara_', CASE WHEN p_size % 2 = 0 THEN 'Men' ELSE 'Women' END, '_', p_type, '_',
                          CAST(p_partkey AS VARCHAR), '.json') END AS file_path,
         CASE WHEN p_size % 4 <> 0 THEN concat('https://shop/', CAST(p_partkey AS VARCHAR)) END AS url,
         CASE WHEN p_size % 8 <> 0 THEN concat('https://seen/', CAST(p_partkey AS VARCHAR)) END AS scraped_url
  FROM part)"""


def paths(spark, d):
    key = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(
        "p_partkey",
        "p_type",
        "p_size",
        "p_retailprice",
        F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("/raw/other/"), key, F.lit(".json")))
        .otherwise(
            F.concat(
                F.lit("/raw/zara/zara_"), F.when(F.col("p_size") % 2 == 0, "Men").otherwise("Women"), F.lit("_"), "p_type", F.lit("_"), key, F.lit(".json")
            )
        )
        .alias("file_path"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("https://shop/"), key)).alias("url"),
        F.when(F.col("p_size") % 8 != 0, F.concat(F.lit("https://seen/"), key)).alias("scraped_url"),
    )


@register(
    "attrs_from_path",
    with_(PATHS_SQL)
    + r"""SELECT p_partkey, lower(regexp_extract(file_path, 'zara_([^_]+)_', 1)) AS gender,
       lower(regexp_extract(file_path, 'zara_[^_]+_([^_]+)_', 1)) AS sub_category,
       regexp_extract(file_path, 'zara_([^_]+)_', 1) AS gender_raw,
       lower(regexp_extract(file_path, 'zara_([^_]+)_', 1)) || '_' || lower(regexp_extract(file_path, 'zara_[^_]+_([^_]+)_', 1)) AS category_joined,
       concat_ws('_', 'zara', CASE WHEN p_size % 3 <> 0 THEN 'men' END, lower(p_type), CAST(p_partkey AS VARCHAR)) AS name_skip,
       'zara' || '_' || (CASE WHEN p_size % 3 <> 0 THEN 'men' END) || '_' || lower(p_type) || '_' || CAST(p_partkey AS VARCHAR) || '.jpg' AS name_strict,
       '/raw/zara/image/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS img_hdfs_path,
       coalesce(url, scraped_url) AS origin_url,
       'https://www.zara.com/kr/ko/share/-p' || CAST(p_partkey AS VARCHAR) || '.html' AS built_url
FROM paths""",
)
def attrs_from_path(spark, d):
    key = F.col("p_partkey").cast("string")
    gender, sub = G.attrs_from_path(F.col("file_path"), "zara")
    raw_gender, _ = G.attrs_from_path(F.col("file_path"), "zara", lower=False)
    sometimes = F.when(F.col("p_size") % 3 != 0, "men")
    return paths(spark, d).select(
        "p_partkey",
        gender.alias("gender"),
        G.category_code(gender, sub).alias("sub_category"),
        raw_gender.alias("gender_raw"),
        G.category_code(gender, sub, joined=True).alias("category_joined"),
        G.image_name(F.lit("zara"), sometimes, F.lower("p_type"), key).alias("name_skip"),
        G.image_name(F.lit("zara"), sometimes, F.lower("p_type"), key, skip_nulls=False).alias("name_strict"),
        G.image_path("/raw/zara/image", key, ".jpg").alias("img_hdfs_path"),
        G.origin_url(F.col("url"), F.col("scraped_url")).alias("origin_url"),
        G.url_from_code("https://www.zara.com/kr/ko/share/-p", key, ".html").alias("built_url"),
    )


@register(
    "price_and_key_columns",
    """WITH t AS (SELECT p_partkey, p_size, p_name, p_brand,
         CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '12,' || CAST(p_size AS VARCHAR) || '0' WHEN 2 THEN 'n/a'
              ELSE CAST(p_partkey AS VARCHAR) END AS price_text,
         CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN CAST(p_retailprice AS DECIMAL(12,2))::VARCHAR ELSE 'abc' END AS base_text
       FROM part)
SELECT p_partkey, coalesce(try_cast(price_text AS INTEGER), 0) AS int_price,
       coalesce(try_cast(nullif(regexp_replace(price_text, '[^0-9]', '', 'g'), '') AS INTEGER), 0) AS digits_price,
       coalesce(CAST(trunc(try_cast(nullif(base_text, '') AS DOUBLE)) AS INTEGER), 0) AS csv_price,
       coalesce(price_text, p_brand) AS key_value,
       coalesce(nullif(trim(base_text), ''), nullif(trim(price_text), ''), p_name) AS first_value,
       printf('TT%04d', p_partkey * 7) AS surrogate
FROM t""",
)
def price_and_key_columns(spark, d):
    size = F.col("p_size")
    t = table(spark, d, "part").select(
        "p_partkey",
        "p_name",
        "p_brand",
        F.when(size % 5 == 0, None)
        .when(size % 5 == 1, F.concat(F.lit("12,"), size.cast("string"), F.lit("0")))
        .when(size % 5 == 2, "n/a")
        .otherwise(F.col("p_partkey").cast("string"))
        .alias("price_text"),
        F.when(size % 4 == 0, "")
        .when(size % 4 == 1, None)
        .when(size % 4 == 2, F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
        .otherwise("abc")
        .alias("base_text"),
    )
    return t.select(
        "p_partkey",
        G.int_or_zero(F.col("price_text")).alias("int_price"),
        X.digits_only_price(F.col("price_text")).alias("digits_price"),
        G.price_or_zero(F.col("base_text")).alias("csv_price"),
        G.coalesce_key(F.col("price_text"), F.col("p_brand")).alias("key_value"),
        X.first_nonempty(F.col("base_text"), F.col("price_text"), F.col("p_name")).alias("first_value"),
        G.surrogate_id("TT", F.col("p_partkey") * 7).alias("surrogate"),
    )


@register(
    "filter_attr_keys",
    """SELECT p_partkey,
  CASE WHEN p_size % 6 = 0 THEN '{}' WHEN p_size % 6 = 1 THEN '{}'
       WHEN p_size % 6 = 2 THEN '{"소재":"' || p_name || '"}'
       ELSE '{"소재":"' || p_name || '","색상":"' || p_type || '"}' END AS kept
FROM part""",
)
def filter_attr_keys(spark, d):
    size = F.col("p_size")
    attrs = (
        F.when(size % 6 == 0, None)
        .when(size % 6 == 1, "{broken")
        .when(size % 6 == 2, F.concat(F.lit('{"소재":"'), "p_name", F.lit('","교환 및 반품":"x","SSF SHOP 안내":"y"}')))
        .otherwise(F.concat(F.lit('{"소재":"'), "p_name", F.lit('","배송 안내":"z","색상":"'), "p_type", F.lit('"}')))
    )
    return table(spark, d, "part").select("p_partkey", X.filter_attr_keys(attrs).alias("kept"))


@register(
    "attrs_json",
    """SELECT p_partkey, '{"color":"' || p_type || '","name":"' || p_name || '"}' AS detail_desc FROM part""",
)
def attrs_json(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.to_json(F.create_map(F.lit("color"), "p_type", F.lit("name"), "p_name")).alias("detail_desc")
    )


@register(
    "brand_alias",
    f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '자라' WHEN 1 THEN '에잇세컨즈' WHEN 2 THEN '무신사' WHEN 3 THEN '유니클로'
       WHEN 4 THEN '탑텐' ELSE lower(p_brand) END AS alias FROM part""",
)
def brand_alias(spark, d):
    names = F.array(*[F.lit(b) for b in ("Zara", "8SECONDS", "musinsa", "Uniqlo", "TopTen")])
    brand = F.coalesce(F.try_element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.brand_alias(brand).alias("alias"))


NAMES_SQL = """names AS (
  SELECT p_partkey, p_brand,
         CASE p_partkey % 5 WHEN 0 THEN '[여성] ' || p_name || ' 2024 신상' WHEN 1 THEN 'ZARA ' || p_name || ' (' || p_type || ') basic'
              WHEN 2 THEN '정품 2024' WHEN 3 THEN NULL ELSE p_name END AS name,
         CASE p_partkey % 4 WHEN 0 THEN 'AB' || CAST(p_partkey AS VARCHAR) || '-01_2' WHEN 1 THEN 'A_' || CAST(p_partkey AS VARCHAR) || '-9'
              WHEN 2 THEN '' ELSE 'LONGCODE' || CAST(p_partkey AS VARCHAR) || 'XYZ' END AS code
  FROM part)"""


def names(spark, d):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    return table(spark, d, "part").select(
        "p_partkey",
        "p_brand",
        F.when(kind == 0, F.concat(F.lit("[여성] "), "p_name", F.lit(" 2024 신상")))
        .when(kind == 1, F.concat(F.lit("ZARA "), "p_name", F.lit(" ("), "p_type", F.lit(") basic")))
        .when(kind == 2, "정품 2024")
        .when(kind == 3, None)
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("AB"), key, F.lit("-01_2")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("A_"), key, F.lit("-9")))
        .when(F.col("p_partkey") % 4 == 2, "")
        .otherwise(F.concat(F.lit("LONGCODE"), key, F.lit("XYZ")))
        .alias("code"),
    )


CLEANED_SQL = "split_part(split_part(trim(code), '-', 1), '_', 1)"
CORE_SQL = f"""list_filter(string_split_regex(trim(regexp_replace(name, '[^가-힣a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'),
     lambda w: w <> '' AND NOT list_contains([{sql_in(C.NAME_STOPWORDS)}], lower(w)) AND NOT regexp_full_match(w, '[0-9]+'))"""
KEYWORDS_SQL = f"""CASE WHEN coalesce(name, '') = '' THEN '' WHEN len({CORE_SQL}) > 0
     THEN array_to_string(({CORE_SQL})[1:3], ' ') ELSE name END"""


@register(
    "core_keywords",
    with_(NAMES_SQL)
    + f"""SELECT p_partkey, {CLEANED_SQL} AS cleaned, length({CLEANED_SQL}) BETWEEN 1 AND 10 AS valid,
       {KEYWORDS_SQL} AS core, lower(regexp_replace(name, '[^가-힣a-zA-Z0-9]', '', 'g')) AS normal
FROM names""",
)
def core_keywords(spark, d):
    cleaned = X.clean_model_code(F.col("code"))
    return names(spark, d).select(
        "p_partkey",
        cleaned.alias("cleaned"),
        X.is_valid_code(cleaned).alias("valid"),
        X.core_keywords(F.col("name")).alias("core"),
        X.norm_text(F.col("name")).alias("normal"),
    )


@register(
    "search_queries",
    with_(
        NAMES_SQL,
        f"""parts AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 3 = 0 THEN 'ZARA' ELSE p_brand END) AS en,
    CASE WHEN p_partkey % 3 = 0 THEN '자라' ELSE lower(p_brand) END AS ko, {KEYWORDS_SQL} AS core, {CLEANED_SQL} AS cleaned FROM names)""",
        """phrases AS (
  SELECT p_partkey, 0 AS ord, 'ko_name' AS kind, trim(ko || ' ' || core) AS query, ko, en FROM parts WHERE core <> ''
  UNION ALL SELECT p_partkey, 1, 'en_name', trim(en || ' ' || core), ko, en FROM parts WHERE core <> ''
  UNION ALL SELECT p_partkey, 2, 'ko_code', trim(ko || ' ' || cleaned), ko, en FROM parts WHERE length(cleaned) BETWEEN 1 AND 10
  UNION ALL SELECT p_partkey, 3, 'en_code', trim(en || ' ' || cleaned), ko, en FROM parts WHERE length(cleaned) BETWEEN 1 AND 10)""",
    )
    + "SELECT p_partkey, ord, kind, query FROM phrases WHERE trim(replace(replace(query, ko, ''), en, '')) <> ''",
)
def search_queries(spark, d):
    brand = F.when(F.col("p_partkey") % 3 == 0, "ZARA").otherwise(F.col("p_brand"))
    entries = X.search_queries(brand, F.col("name"), F.col("code"))
    return names(spark, d).select("p_partkey", F.explode(entries).alias("q")).select("p_partkey", "q.*")


def _similarity_input(spark, d):
    part = D.products(spark, d).select("product_id", "prod_name")
    titles = D.staged_offers(spark, d).select("product_id", "offer_id", "pos", X.strip_markup(F.col("title")).alias("title"))
    return titles.join(part, "product_id")


@register(
    "title_similarity_levenshtein",
    with_(
        PRODUCTS_SQL,
        STAGED_OFFERS_SQL,
        """t AS (SELECT pos, regexp_replace(title, '</?b>', '', 'g') AS title, prod_name,
    lower(regexp_replace(prod_name, '[^가-힣a-zA-Z0-9]', '', 'g')) AS a,
    lower(regexp_replace(regexp_replace(title, '</?b>', '', 'g'), '[^가-힣a-zA-Z0-9]', '', 'g')) AS b
  FROM staged JOIN products USING (product_id))""",
    )
    + """SELECT pos, title, CASE WHEN a <> '' AND contains(b, a) THEN 1.0::DOUBLE
       ELSE round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) END AS similarity FROM t""",
)
def title_similarity_levenshtein(spark, d):
    similarity = X.title_similarity(F.col("prod_name"), F.col("title"))
    return _similarity_input(spark, d).select("pos", "title", F.round(similarity, 6).alias("similarity"))


@register(
    "expand_category",
    """WITH t AS (SELECT p_partkey, p_type, list_extract(['top', ' Bottom ', 'OUTER', '상의', '아우터', p_type], CAST(p_partkey % 6 + 1 AS INTEGER)) AS word FROM part)
SELECT p_partkey, array_to_string(CASE p_partkey % 6
  WHEN 0 THEN ['top', 'Top', '상의'] WHEN 1 THEN ['bottom', 'Bottom', '하의', 'top', 'Top', '상의']
  WHEN 2 THEN ['outer', 'Outer', '아우터'] WHEN 3 THEN ['상의', 'top', 'Top']
  WHEN 4 THEN ['아우터', 'outer', 'Outer']
  ELSE [p_type, lower(p_type), upper(p_type[1]) || lower(p_type[2:])] END, '|') AS spellings,
  array_to_string(CASE p_partkey % 6 WHEN 0 THEN ['top', '상의'] WHEN 1 THEN ['bottom', '하의'] WHEN 2 THEN ['outer', '아우터']
  WHEN 3 THEN ['상의'] WHEN 4 THEN ['아우터'] ELSE [lower(p_type)] END, '|') AS codes
FROM t""",
)
def expand_category(spark, d):
    key = F.col("p_partkey") % 6
    words = F.array(*[F.lit(w) for w in ("top", " Bottom ", "OUTER", "상의", "아우터")])
    word = F.coalesce(F.try_element_at(words, (key + 1).cast("int")), F.col("p_type"))
    values = F.when(key == 1, F.array(word, F.lit(""), F.lit("top"))).otherwise(F.array(word))
    return table(spark, d, "part").select(
        "p_partkey",
        F.array_join(X.expand_category(values), "|").alias("spellings"),
        F.array_join(X.expand_category_code(word), "|").alias("codes"),
    )


@register(
    "filter_lists",
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN p_type || ' , ,' || p_brand
         WHEN 3 THEN ',,' ELSE p_type END AS raw,
         CASE WHEN p_partkey % 2 = 0 THEN 'men_' || p_type || '_x' ELSE p_type END AS category,
         CASE WHEN p_partkey % 3 = 0 THEN 'women' END AS gender FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN p_type_list WHEN 4 THEN raw END AS parts,
       CASE WHEN p_partkey % 2 = 0 AND gender IS NULL THEN 'men' ELSE gender END AS gender_filter,
       CASE WHEN p_partkey % 2 = 0 AND gender IS NULL THEN category[5:] ELSE category END AS category_filter
FROM (SELECT *, array_to_string([trim(x) for x in string_split(raw, ',') if trim(x) <> ''], '|') AS p_type_list FROM t)""",
)
def filter_lists(spark, d):
    key = F.col("p_partkey")
    raw = (
        F.when(key % 5 == 0, None)
        .when(key % 5 == 1, "  ")
        .when(key % 5 == 2, F.concat("p_type", F.lit(" , ,"), "p_brand"))
        .when(key % 5 == 3, ",,")
        .otherwise(F.col("p_type"))
    )
    category = F.when(key % 2 == 0, F.concat(F.lit("men_"), "p_type", F.lit("_x"))).otherwise(F.col("p_type"))
    gender, rest = X.split_legacy_filter(category, F.when(key % 3 == 0, "women"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.array_join(X.parse_filter_list(raw), "|").alias("parts"),
        gender.alias("gender_filter"),
        rest.alias("category_filter"),
    )


@register(
    "rewrite_gate",
    r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'find ABC1234567 now' WHEN turn % 4 = 2 THEN text ELSE split_part(text, ' ', 1) END AS q,
       conv_id % 5 = 0 AS has_image, CASE WHEN conv_id % 7 = 0 THEN 'top' ELSE ' ' END AS category FROM conversations)
SELECT conv_id, turn, trim(coalesce(q, '')) <> '' AND length(trim(q)) <= 20 AND NOT has_image AND trim(category) = ''
       AND NOT regexp_matches(q, '\b[A-Z]{1,5}\d{6,}\b') AS eligible FROM t""",
)
def rewrite_gate(spark, d):
    text = (
        F.when(F.col("turn") % 4 == 3, "find ABC1234567 now")
        .when(F.col("turn") % 4 == 2, F.col("text"))
        .otherwise(F.split("text", " ")[0])
    )
    category = F.when(F.col("conv_id") % 7 == 0, "top").otherwise(" ")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.rewrite_gate(text, F.col("conv_id") % 5 == 0, category).alias("eligible")
    )


@register(
    "extract_json_payload",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN NULL ELSE NULL END AS payload,
  CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) WHEN 1 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
FROM events""",
)
def extract_json_payload(spark, d):
    key = F.col("event_id") % 4
    text = (
        F.when(key == 0, F.concat(F.lit("```json\nSure: "), "props", F.lit("\n``` done")))
        .when(key == 1, F.col("props"))
        .when(key == 2, F.concat(F.lit("{oops "), "props"))
        .otherwise("no object")
    )
    payload = X.extract_json_payload(text)
    return table(spark, d, "events").select(
        "event_id", payload.alias("payload"), F.get_json_object(payload, "$.k").cast("int").alias("k")
    )


@register(
    "url_and_title_cleanup",
    r"""WITH t AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?:', '') WHEN 1 THEN regexp_replace(url, '^https?://[^/]+', '') ELSE url END AS link,
        regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
SELECT page_id, CASE WHEN starts_with(link, '//') THEN 'https:' || link WHEN starts_with(link, '/') THEN 'https://host' || link ELSE link END AS absolute,
       trim(regexp_replace(regexp_replace('[SHOP basic] ' || title || ' (SHOP LINE)', '^\[?SHOP\s?basic.*?\]?\s*', '', 'g'), '\(SHOP LINE\)\s*', '', 'g')) AS title,
       rtrim(regexp_replace(url || ' ', '[<>:"/\\|?*]', '_', 'g')) AS file_name
FROM t""",
)
def url_and_title_cleanup(spark, d):
    key = F.col("page_id") % 3
    link = (
        F.when(key == 0, F.regexp_replace("url", "^https?:", ""))
        .when(key == 1, F.regexp_replace("url", "^https?://[^/]+", ""))
        .otherwise(F.col("url"))
    )
    title = F.concat(F.lit("[SHOP basic] "), F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" (SHOP LINE)"))
    return table(spark, d, "pages").select(
        "page_id",
        X.absolute_url(link, "https://host").alias("absolute"),
        X.clean_title(title, [r"^\[?SHOP\s?basic.*?\]?\s*", r"\(SHOP LINE\)\s*"]).alias("title"),
        X.safe_filename(F.concat("url", F.lit(" "))).alias("file_name"),
    )


@register(
    "discounts",
    with_(PRODUCTS_SQL, OFFERS_SQL)
    + """SELECT offer_id, b - price AS discount, CASE WHEN b > 0 THEN CAST(trunc((b - price)::DOUBLE / b * 100) AS INTEGER) ELSE 0 END AS discount_rate
FROM (SELECT offer_id, price, CASE WHEN price % 50 = 0 THEN 0 ELSE base_price END AS b FROM offers JOIN products USING (product_id))""",
)
def discounts(spark, d):
    joined = D.offers(spark, d).join(D.products(spark, d).select("product_id", "base_price"), "product_id")
    base = F.when(F.col("price") % 50 == 0, 0).otherwise(F.col("base_price"))
    difference, rate = G.discount(base, F.col("price"))
    return joined.select("offer_id", difference.alias("discount"), rate.alias("discount_rate"))


@register(
    "display_defaults",
    with_(PRODUCTS_SQL)
    + f"""SELECT product_id, coalesce(CASE WHEN starts_with(img_hdfs_path, '/') THEN img_hdfs_path ELSE '/' || img_hdfs_path END, '{C.PLACEHOLDER_IMAGE}') AS image_url,
       img_hdfs_path IS NULL AS lacks_image FROM products""",
)
def display_defaults(spark, d):
    from tallyloom.operators.joins import display_path

    return D.products(spark, d).select(
        "product_id", display_path(F.col("img_hdfs_path")).alias("image_url"), F.col("img_hdfs_path").isNull().alias("lacks_image")
    )


@register(
    "sold_out_and_stock",
    """SELECT p_partkey, p_size % 10 = 0 OR p_size % 7 = 0 AS sold_out, CASE WHEN p_size % 10 = 0 OR p_size % 7 = 0 THEN 0 ELSE 999 END AS qty FROM part""",
)
def sold_out_and_stock(spark, d):
    price = F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size"))
    flag = G.sold_out_flag(price, F.array(F.lit(False), F.col("p_size") % 7 == 0))
    return table(spark, d, "part").select("p_partkey", flag.alias("sold_out"), G.stock_qty(flag).alias("qty"))


@register(
    "image_source_urls",
    """WITH t AS (SELECT p_partkey, p_size % 6 AS n, CASE WHEN p_size % 4 <> 0 THEN 'thumb' || CAST(p_partkey AS VARCHAR) END AS thumb FROM part)
SELECT p_partkey, CASE WHEN n >= 3 THEN 'i3' WHEN n >= 5 THEN 'i5' END AS third_or_fifth, CASE WHEN n >= 1 THEN 'i1' END AS first_image,
       coalesce(thumb, CASE WHEN n >= 1 THEN 'i1' END) AS thumb_or_first FROM t""",
)
def image_source_urls(spark, d):
    count = F.col("p_size") % 6
    images = F.filter(F.array(*[F.when(count >= i, F.lit(f"i{i}")) for i in range(1, 6)]), lambda x: x.isNotNull())
    thumb = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("thumb"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select(
        "p_partkey",
        G.image_source_url(images, (3, 5)).alias("third_or_fifth"),
        G.image_source_url(images).alias("first_image"),
        G.image_source_url(images, (1,), thumb).alias("thumb_or_first"),
    )


# --- logs and metrics -------------------------------------------------------

LINES_SQL = """lines AS (
  SELECT event_id, ts, user_id,
    CASE event_id % 9
      WHEN 0 THEN 'GET /x?ERROR HTTP/1.1" 200 ' || event_type
      WHEN 1 THEN 'Unhandled Exception in ' || event_type
      WHEN 2 THEN 'warning: slow ' || event_type
      WHEN 3 THEN 'FATAL: stop'
      WHEN 4 THEN 'critical error ' || event_type
      WHEN 5 THEN '{"t":1,"s":"F","msg":"m ' || event_type || '"}'
      WHEN 6 THEN '{"s":"W","msg":"disk ' || event_type || '"}'
      WHEN 7 THEN CASE event_id % 4 WHEN 0 THEN '{"level":"x","note":"an error"}' WHEN 1 THEN '{"s":"I","msg":"an error"} and more'
        WHEN 2 THEN '{"s":"E","msg":null}' ELSE '{"s":"I","msg":"an error"' END
      ELSE 'plain ' || event_type END AS message
  FROM events)"""

LEVEL_SQL = r"""CASE WHEN regexp_matches(message, 'HTTP/1\.[01]" [23]\d{2}') THEN 'INFO'
  WHEN regexp_matches(lower(message), 'error|exception') THEN 'ERROR' WHEN contains(lower(message), 'warn') THEN 'WARN'
  WHEN regexp_matches(lower(message), 'critical|fatal') THEN 'CRITICAL' ELSE 'INFO' END"""


def lines(spark, d):
    key, kind = F.col("event_id") % 9, F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(key == 0, F.concat(F.lit('GET /x?ERROR HTTP/1.1" 200 '), kind))
        .when(key == 1, F.concat(F.lit("Unhandled Exception in "), kind))
        .when(key == 2, F.concat(F.lit("warning: slow "), kind))
        .when(key == 3, "FATAL: stop")
        .when(key == 4, F.concat(F.lit("critical error "), kind))
        .when(key == 5, F.concat(F.lit('{"t":1,"s":"F","msg":"m '), kind, F.lit('"}')))
        .when(key == 6, F.concat(F.lit('{"s":"W","msg":"disk '), kind, F.lit('"}')))
        .when((key == 7) & (F.col("event_id") % 4 == 0), '{"level":"x","note":"an error"}')
        .when((key == 7) & (F.col("event_id") % 4 == 1), '{"s":"I","msg":"an error"} and more')
        .when((key == 7) & (F.col("event_id") % 4 == 2), '{"s":"E","msg":null}')
        .when(key == 7, '{"s":"I","msg":"an error"')
        .otherwise(F.concat(F.lit("plain "), kind))
        .alias("message"),
    )


@register(
    "log_levels",
    with_(LINES_SQL)
    + f"""SELECT event_id, {LEVEL_SQL} AS inferred, level, body,
       CASE level
         WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END AS rank
FROM (SELECT *, CASE WHEN whole THEN CASE j->>'$.s' WHEN 'F' THEN 'CRITICAL' WHEN 'E' THEN 'ERROR' WHEN 'W' THEN 'WARN' ELSE 'INFO' END ELSE {LEVEL_SQL} END AS level,
        CASE WHEN whole THEN j->>'$.msg' ELSE message END AS body
  FROM (SELECT *, coalesce(json_exists(j, '$.s') AND json_exists(j, '$.msg'), FALSE) AS whole
    FROM (SELECT *, CASE WHEN json_valid(message) THEN message::JSON END AS j FROM lines)))""",
)
def log_levels(spark, d):
    parsed = L.parse_log_line(F.col("message"))
    return lines(spark, d).select(
        "event_id",
        L.infer_log_level(F.col("message")).alias("inferred"),
        parsed["level"].alias("level"),
        parsed["message"].alias("body"),
        L.level_rank(parsed["level"]).alias("rank"),
    )


CONTAINERS = tuple(C.CONTAINER_SERVICE) + ("other-box",)


@register(
    "container_services",
    f"""WITH t AS (SELECT event_id, ts, event_type, list_extract([{sql_in(CONTAINERS)}], CAST(user_id % {len(CONTAINERS)} + 1 AS INTEGER)) AS name FROM events),
r AS (SELECT *, CASE event_id % 6 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name WHEN 3 THEN name
        WHEN 4 THEN nullif(regexp_extract('saw ' || name || ' up', '[\\w-]+-main', 0), '') ELSE '' END AS c FROM t)
SELECT event_id, coalesce(c, '') AS container,
  CASE coalesce(c, '') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CONTAINER_SERVICE.items())} ELSE 'unknown' END AS service,
  concat_ws('_', coalesce(c, ''), strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), substring(md5(event_type), 1, 8)) AS doc_id
FROM r""",
)
def container_services(spark, d):
    key = F.col("event_id") % 6
    name = F.element_at(F.array(*[F.lit(c) for c in CONTAINERS]), (F.col("user_id") % len(CONTAINERS) + 1).cast("int"))
    ids = F.sha2(name, 256)
    t = table(spark, d, "events").select(
        "event_id",
        "ts",
        "event_type",
        F.when(key == 0, name).alias("a"),
        F.when(key == 1, F.concat(F.lit("/"), name)).otherwise("").alias("b"),
        F.when(key == 2, name).alias("c"),
        F.when(key == 3, F.concat(F.lit("/var/lib/docker/containers/"), ids, F.lit("/x-json.log"))).alias("path"),
        F.when(key == 4, F.concat(F.lit("saw "), name, F.lit(" up"))).otherwise("nothing").alias("raw"),
    )
    known = spark.createDataFrame([(c,) for c in CONTAINERS], "name string").withColumn("container_id", F.sha2("name", 256))
    resolved = t.withColumn("cid", L.container_id(F.col("path"))).join(
        F.broadcast(known), F.col("cid") == F.col("container_id"), "left"
    )
    container = L.strip_slash(
        F.coalesce(L.container_from_fields(F.col("a"), F.col("b"), F.col("c")), F.col("name"), L.container_in_text(F.col("raw")))
    )
    return resolved.select(
        "event_id",
        container.alias("container"),
        L.service_of(container).alias("service"),
        L.log_doc_id(container, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("event_type")).alias("doc_id"),
    )


@register(
    "container_stats",
    """WITH t AS (SELECT event_id, event_id * 7 % 1000 AS used, event_id * 5 % 900 AS used_before, event_id * 11 % 5000 AS sys, event_id * 3 % 4000 AS sys_before,
        CAST(floor(value * 1048576) AS BIGINT) AS mem, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 536870912 END AS lim, user_id FROM events)
SELECT event_id,
  CASE WHEN sys > 0 AND sys_before > 0 AND sys - sys_before > 0 AND used - used_before > 0 THEN round((used - used_before)::DOUBLE / (sys - sys_before) * 100, 2) ELSE 0 END::DOUBLE AS cpu_strict,
  CASE WHEN sys - sys_before > 0 THEN round((used - used_before)::DOUBLE / (sys - sys_before) * 100, 2) ELSE 0 END::DOUBLE AS cpu_snapshot,
  CASE WHEN lim > 0 THEN round(mem::DOUBLE / lim * 100, 2) ELSE 0 END::DOUBLE AS mem_percent,
  round(mem::DOUBLE / 1024 / 1024, 2) AS mem_mb, 'svc' || CAST(user_id % 8 AS VARCHAR) AS prefix
FROM t""",
)
def container_stats(spark, d):
    e = F.col("event_id")
    used, before, system, system_before = e * 7 % 1000, e * 5 % 900, e * 11 % 5000, e * 3 % 4000
    memory = F.floor(F.col("value") * 1048576).cast("long")
    limit = F.when(e % 10 == 0, 0).otherwise(536870912)
    name = F.concat(F.lit("svc"), (F.col("user_id") % 8).cast("string"), F.lit("-c-1"))
    return table(spark, d, "events").select(
        "event_id",
        F.round(L.cpu_percent(used, before, system, system_before), 2).alias("cpu_strict"),
        F.round(L.cpu_percent(used, before, system, system_before, strict=False), 2).alias("cpu_snapshot"),
        F.round(L.memory_percent(memory, limit), 2).alias("mem_percent"),
        F.round(L.mb(memory), 2).alias("mem_mb"),
        L.service_prefix(name).alias("prefix"),
    )


@register(
    "active_hours",
    """SELECT event_id, hour(ts + INTERVAL 9 HOUR) >= 22 OR hour(ts + INTERVAL 9 HOUR) < 6 AS night,
       hour(ts + INTERVAL 9 HOUR) >= 9 AND hour(ts + INTERVAL 9 HOUR) < 18 AS office, TRUE AS always FROM events""",
)
def active_hours(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id",
        L.in_active_hours(ts, 22, 6).alias("night"),
        L.in_active_hours(ts, 9, 18).alias("office"),
        L.in_active_hours(ts, None, None).alias("always"),
    )


# --- predicates -------------------------------------------------------------


@register(
    "product_filters",
    with_(PRODUCTS_SQL)
    + """SELECT product_id, prod_name FROM products
WHERE category_code = 'large' AND prod_name ILIKE '%Ing%' AND lower(category_code) IN ('large', 'small') AND gender = 'men' AND img_hdfs_path IS NOT NULL""",
)
def product_filters(spark, d):
    condition = P.all_of(
        P.equal_if(F.col("category_code"), "large"),
        P.equal_if(F.col("brand_name"), None),
        P.contains_text(F.col("prod_name"), "Ing"),
        P.in_list(F.col("category_code"), ["Large", "small", ""]),
        P.in_list(F.col("gender"), "MEN"),
        P.exists_field(F.col("img_hdfs_path")),
    )
    return D.products(spark, d).filter(condition).select("product_id", "prod_name")


@register(
    "substring_with_wildcards",
    """SELECT p_partkey FROM part WHERE contains(lower(p_name || '_50%_' || p_type), lower('e_50%_S'))""",
)
def substring_with_wildcards(spark, d):
    text = F.concat("p_name", F.lit("_50%_"), "p_type")
    return table(spark, d, "part").filter(P.contains_text(text, "e_50%_S")).select("p_partkey")


@register(
    "log_lookback",
    with_(LOGS_SQL)
    + """SELECT event_id, level, service FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR AND level = 'ERROR'""",
)
def log_lookback(spark, d):
    condition = P.all_of(
        P.since(F.col("timestamp"), dt.datetime(2024, 1, 31), 168),
        P.phrase(F.col("level"), "ERROR"),
        P.phrase(F.col("service"), "ALL"),
    )
    return D.logs(spark, d).filter(condition).select("event_id", "level", "service")


@register(
    "registered_on_day",
    with_(PRODUCTS_SQL) + "SELECT product_id, create_dt FROM products WHERE CAST(create_dt AS DATE) = DATE '2024-01-10'",
)
def registered_on_day(spark, d):
    return D.products(spark, d).filter(P.on_day(F.col("create_dt"), dt.date(2024, 1, 10))).select("product_id", "create_dt")


@register(
    "log_phrase",
    with_(LOGS_SQL) + r"""SELECT event_id, message FROM logs WHERE regexp_matches(lower(message), '\bk=1\b') AND level = 'WARN'""",
)
def log_phrase(spark, d):
    condition = P.all_of(P.text_phrase(F.col("message"), "K=1"), P.phrase(F.col("level"), "WARN"), P.phrase(F.col("service"), None))
    return D.logs(spark, d).filter(condition).select("event_id", "message")


SHIPPED_SQL = """shipped AS (
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'GET /health from kafka-main' WHEN 1 THEN '   at com.x.Y fastapi-main'
     WHEN 2 THEN 'Connection ended ERROR postgres-main' WHEN 3 THEN 'Block pool Failed' WHEN 4 THEN 'spark-master-main ' || event_type
     WHEN 5 THEN 'healthcheck' ELSE event_type END AS message FROM events)"""
CHATTER_SQL = f"""(regexp_matches(message, '{"|".join(C.CHATTER)}') OR regexp_matches(message, '^\\s+at '))"""


@register(
    "shipper_rules",
    with_(SHIPPED_SQL)
    + f"""SELECT event_id, NOT {CHATTER_SQL} OR regexp_matches(message, 'ERROR|Exception|Failed|CRITICAL') AS kept_intended,
       NOT {CHATTER_SQL} AS kept_as_shipped, regexp_matches(message, '{"|".join(C.CORE_CONTAINERS)}') AS core FROM shipped""",
)
def shipper_rules(spark, d):
    key = F.col("event_id") % 7
    message = (
        F.when(key == 0, "GET /health from kafka-main")
        .when(key == 1, "   at com.x.Y fastapi-main")
        .when(key == 2, "Connection ended ERROR postgres-main")
        .when(key == 3, "Block pool Failed")
        .when(key == 4, F.concat(F.lit("spark-master-main "), "event_type"))
        .when(key == 5, "healthcheck")
        .otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select(
        "event_id",
        P.keep_log_line(message).alias("kept_intended"),
        P.keep_log_line(message, keep_errors=False).alias("kept_as_shipped"),
        P.mentions_core_container(message).alias("core"),
    )


@register(
    "offer_gates",
    with_(PRODUCTS_SQL, STAGED_OFFERS_SQL)
    + """SELECT pos, product_id, regexp_matches(title, '구매대행|구제|중고|병행수입') AS spam,
  base_price <= 0 OR (price > base_price * 0.3::DOUBLE AND price < base_price * 2.5::DOUBLE) AS plausible,
  contains(lower(replace(regexp_replace(title, '</?b>', '', 'g'), ' ', '')), lower(split_part(model_code, '-', 1))) AS exact_code,
  (NOT contains(kind, 'code') OR contains(lower(replace(regexp_replace(title, '</?b>', '', 'g'), ' ', '')), lower(split_part(model_code, '-', 1))))
   AND price % 100 / 100.0::DOUBLE >= CASE WHEN contains(lower(replace(regexp_replace(title, '</?b>', '', 'g'), ' ', '')), lower(split_part(model_code, '-', 1))) THEN 0.175::DOUBLE ELSE 0.35::DOUBLE END AS gate
FROM staged JOIN products USING (product_id)""",
)
def offer_gates(spark, d):
    rows = D.staged_offers(spark, d).join(D.products(spark, d).select("product_id", "base_price", "model_code"), "product_id")
    title = X.strip_markup(F.col("title"))
    exact = P.has_exact_code(title, F.col("model_code"))
    return rows.select(
        "pos",
        "product_id",
        P.is_spam_title(F.col("title")).alias("spam"),
        P.plausible_price(F.col("price"), F.col("base_price")).alias("plausible"),
        exact.alias("exact_code"),
        P.similarity_gate(F.col("kind").endswith("_code"), exact, F.col("price") % 100 / 100.0).alias("gate"),
    )


@register(
    "searchable_products",
    """SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END <> ''
  AND (CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END <> ' ' OR p_partkey % 8 <> 0)""",
)
def searchable_products(spark, d):
    key = F.col("p_partkey")
    return (
        table(spark, d, "part")
        .filter(
            P.searchable(
                F.when(key % 6 == 0, "").otherwise(F.col("p_brand")),
                F.when(key % 4 == 0, " ").otherwise(F.col("p_name")),
                F.when(key % 8 != 0, "code"),
            )
        )
        .select("p_partkey")
    )


@register(
    "alertable_logs",
    with_(LOGS_SQL)
    + """SELECT event_id FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-02 00:05:00'
  AND (hour("timestamp" + INTERVAL 9 HOUR) >= 22 OR hour("timestamp" + INTERVAL 9 HOUR) < 6)
  AND service NOT IN ('svc3') AND level IN ('CRITICAL', 'ERROR')
  AND NOT regexp_matches(lower(CASE WHEN event_id % 5 = 0 THEN 'Connection refused by ' || message ELSE message END), 'connection refused|warn datanode')""",
)
def alertable_logs(spark, d):
    message = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Connection refused by "), "message")).otherwise(F.col("message"))
    condition = P.alertable(
        F.col("level"), F.col("service"), message, F.col("timestamp"),
        started_at=dt.datetime(2024, 1, 2), hours=(22, 6), excluded=["svc3"], min_level="ERROR",
    )
    return D.logs(spark, d).filter(condition).select("event_id")


@register(
    "startup_noise",
    f"""WITH t AS (SELECT event_id, concat('Seen: ', upper(list_extract([{sql_in(C.STARTUP_NOISE + ('all quiet', 'ready'))}], CAST(event_id % {len(C.STARTUP_NOISE) + 2} + 1 AS INTEGER)))) AS m FROM events)
SELECT event_id, event_id % {len(C.STARTUP_NOISE) + 2} < {len(C.STARTUP_NOISE)} AS noise FROM t""",
)
def startup_noise(spark, d):
    words = C.STARTUP_NOISE + ("all quiet", "ready")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", L.is_startup_noise(F.concat(F.lit("Seen: "), F.upper(word))).alias("noise")
    )


@register(
    "record_completeness",
    """SELECT p_partkey, p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS complete, p_size >= 10 AND p_size * 2 >= 10 AS big_enough FROM part""",
)
def record_completeness(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        P.complete_record(
            F.when(key % 9 == 0, "failed"), F.when(key % 7 != 0, F.col("p_name")), F.when(key % 5 == 0, "").otherwise("code")
        ).alias("complete"),
        P.big_enough(F.col("p_size"), F.col("p_size") * 2).alias("big_enough"),
    )


@register("rejected_records", "SELECT p_partkey FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def rejected_records(spark, d):
    """The side output of the completeness check."""
    from tallyloom.operators.keyed import split_rejected

    key = F.col("p_partkey")
    fine = P.complete_record(
        F.when(key % 9 == 0, "failed"), F.when(key % 7 != 0, F.col("p_name")), F.when(key % 5 == 0, "").otherwise("code")
    )
    return split_rejected(table(spark, d, "part"), fine)[1].select("p_partkey")
