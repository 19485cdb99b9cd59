"""Field extraction from pages: the given ones, and shop pages built from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import pages as H
from tallyloom.plans import domain as D
from tallyloom.queries import register


@register("page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, d):
    return D.table(spark, d, "pages").select("page_id", H.extract_meta(F.col("html"))["title"].alias("title"))


@register(
    "page_link_ids",
    """SELECT DISTINCT id FROM (SELECT unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS id FROM pages) WHERE length(id) >= 3""",
)
def page_link_ids(spark, d):
    return H.extract_ids(D.table(spark, d, "pages").select("html"), 'href="/([^"/]+)"', shortest=3)


def shop_pages(spark, d):
    key = F.col("p_partkey").cast("string")
    head = F.concat(
        F.lit("<html><head><TITLE>Shop\n  "), "p_name", F.lit("</TITLE>"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit(' | Shop"/>'))).otherwise(""),
        F.lit('<meta property="og:image" content="https://cdn/'), key, F.lit('.jpg"/><meta property="product:price:amount" content="'),
        F.floor("p_retailprice").cast("string"), F.lit('.00"/></head><body>'),
    )
    images = F.concat(
        F.lit('<IMG class="a" src="//cdn/'), key, F.lit('.jpg"><img src=\'/img/icon.png\'><img alt="x" src="/img/'), key,
        F.lit('_2.jpg"><img src="//cdn/'), key, F.lit('.jpg"/>'),
    )
    specs = F.concat(
        F.lit("<table><tr><th>Brand</th><td> "), "p_brand", F.lit("\n x</td></tr><tr><th>Type</th> <td><b>old</b></td></tr><tr><th></th><td>none</td></tr></table><dl><dt>Type</dt><dd>"),
        "p_type", F.lit("</dd></dl>"),
    )
    state = F.concat(
        F.lit('<script id="__STATE__" type="application/json">{"goodsNo":'), key, F.lit(',"price":{"sale":'),
        F.col("p_size").cast("string"), F.lit('}}</script><a href="/products/P'), key, F.lit('-0">x</a></body>'),
    )
    return D.table(spark, d, "part").select("p_partkey", F.concat(head, images, specs, state).alias("html"))


@register(
    "shop_page_meta",
    """SELECT p_partkey, 'Shop ' || p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_name ELSE 'Shop ' || p_name END AS name,
  'https://cdn/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image, CAST(floor(p_retailprice) AS INTEGER) AS price FROM part""",
)
def shop_page_meta(spark, d):
    return shop_pages(spark, d).select("p_partkey", H.extract_meta(F.col("html")).alias("m")).select("p_partkey", "m.*")


@register("shop_page_ids", "SELECT DISTINCT 'P' || CAST(p_partkey AS VARCHAR) || '-0' AS id FROM part WHERE length(CAST(p_partkey AS VARCHAR)) >= 2")
def shop_page_ids(spark, d):
    return H.extract_ids(shop_pages(spark, d), "/products/([A-Z0-9-]+)", shortest=5)


@register(
    "shop_page_images",
    """SELECT p_partkey, 'https://cdn/' || CAST(p_partkey AS VARCHAR) || '.jpg|https://host/img/' || CAST(p_partkey AS VARCHAR) || '_2.jpg' AS images FROM part""",
)
def shop_page_images(spark, d):
    return shop_pages(spark, d).select(
        "p_partkey", F.array_join(H.extract_images(F.col("html"), "https://host"), "|").alias("images")
    )


@register(
    "shop_page_specs",
    """SELECT p_partkey, p_brand || ' x' AS brand, p_type AS type, CAST(2 AS INTEGER) AS entries FROM part""",
)
def shop_page_specs(spark, d):
    specs = H.extract_specs(F.col("html"))
    return shop_pages(spark, d).select("p_partkey", specs.alias("s")).select(
        "p_partkey", F.col("s")["Brand"].alias("brand"), F.col("s")["Type"].alias("type"), F.size("s").alias("entries")
    )


@register("shop_page_state", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS goods_no, p_size AS price FROM part")
def shop_page_state(spark, d):
    state = H.extract_json_state(F.col("html"), "__STATE__")
    return shop_pages(spark, d).select(
        "p_partkey",
        F.get_json_object(state, "$.goodsNo").alias("goods_no"),
        F.get_json_object(state, "$.price.sale").cast("int").alias("price"),
    )


@register(
    "expand_variants",
    """WITH t AS (SELECT p_partkey, 'G' || CAST(p_partkey AS VARCHAR) AS g, 'u' || CAST(p_partkey AS VARCHAR) AS u, p_size, p_type FROM part)
SELECT g AS "goodsNo", NULL::VARCHAR AS color_name, u AS url, 'thumb' AS "thumbnailImageUrl" FROM t WHERE p_size % 3 = 0
UNION ALL SELECT g || '_01', 'red', u || '?colorDisplayCode=01', 'icon' FROM t WHERE p_size % 3 <> 0
UNION ALL SELECT g || '_02', p_type, u || '?colorDisplayCode=02', 'thumb' FROM t WHERE p_size % 3 = 2""",
)
def expand_variants(spark, d):
    key = F.col("p_partkey").cast("string")

    def color(code, name, icon):
        return F.struct(F.lit(code).alias("color_code"), name.alias("color_name"), F.lit(icon).alias("icon_url"))

    colors = F.filter(
        F.array(
            F.when(F.col("p_size") % 3 != 0, color("01", F.lit("red"), "icon")),
            F.when(F.col("p_size") % 3 == 2, color("02", F.col("p_type"), "")),
        ),
        lambda c: c.isNotNull(),
    )
    records = D.table(spark, d, "part").select(
        F.concat(F.lit("G"), key).alias("goodsNo"), F.concat(F.lit("u"), key).alias("url"), F.lit("thumb").alias("thumbnailImageUrl"), colors.alias("colors")
    )
    return H.expand_variants(records).select("goodsNo", "color_name", "url", "thumbnailImageUrl")


@register(
    "selected_attributes",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ' x' ELSE p_name END AS fit, CASE WHEN p_size % 5 = 0 THEN p_brand END AS season FROM part""",
)
def selected_attributes(spark, d):
    def item(name, selected):
        return F.struct(name.alias("name"), selected.alias("isSelected"))

    def material(name, *items):
        return F.struct(F.lit(name).alias("name"), F.array(*items).alias("items"))

    materials = F.array(
        material("fit", item(F.concat("p_type", F.lit("|x")), F.col("p_size") % 2 == 0), item(F.col("p_name"), F.lit(True))),
        material("season", item(F.col("p_brand"), F.col("p_size") % 5 == 0), item(F.lit("never"), F.lit(False))),
    )
    chosen = D.table(spark, d, "part").select("p_partkey", H.selected_attributes(materials).alias("a"))
    return chosen.select("p_partkey", F.col("a")["fit"].alias("fit"), F.col("a")["season"].alias("season"))
