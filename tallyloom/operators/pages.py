"""Field extraction from raw pages with JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import absolute_url

# Page patterns.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
IMG_SRC = r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"
TH_TD = r"(?is)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
DT_DD = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"


def first_match(html: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


def meta_content(html: Column, prop: str) -> Column:
    """``content`` of the ``<meta property=..>`` tag."""
    return first_match(html, rf'(?i)<meta\s+property="{prop}"\s+content="([^"]*)"')


def title_part(title: Column) -> Column:
    """What stands before the first '|'."""
    return F.trim(F.substring_index(title, "|", 1))


def extract_meta(html: Column) -> Column:
    """Struct (title, og_title, og_image, price); the name is og:title up to '|', else the page title."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"\s+", " "))
    og_title = meta_content(html, "og:title")
    price = meta_content(html, "product:price:amount")
    return F.struct(
        title.alias("title"),
        F.coalesce(title_part(og_title), title).alias("name"),
        F.coalesce(meta_content(html, "og:image"), F.lit("")).alias("image"),
        F.coalesce(F.regexp_extract(price, r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias("price"),
    )


def extract_ids(pages: DataFrame, pattern: str, html: str = "html", shortest: int = 1) -> DataFrame:
    """Distinct ids in the pages' links; each page is made distinct before the shuffle."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), 1))
    return pages.select(F.explode(found).alias("id")).filter(F.length("id") >= shortest).distinct()


def extract_images(html: Column, host: str) -> Column:
    """Absolute image addresses, once each, in order, without icons and logos."""
    sources = F.transform(F.regexp_extract_all(html, F.lit(IMG_SRC), 1), lambda s: absolute_url(s, host))
    return F.array_distinct(F.filter(sources, lambda s: ~s.rlike("icon|logo")))


def extract_specs(html: Column) -> Column:
    """th/td and dt/dd pairs as a map, white space collapsed; a later pair replaces an earlier one."""

    def clean(text: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", " "))

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(html, F.lit(pattern), 1).alias("k"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("v")
        )

    def tidy(items: Column) -> Column:
        return F.transform(items, lambda p: F.struct(clean(p["k"]).alias("k"), clean(p["v"]).alias("v")))

    both = F.filter(F.concat(tidy(pairs(TH_TD)), tidy(pairs(DT_DD))), lambda p: (p["k"] != "") & (p["v"] != ""))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        both, empty, lambda seen, p: F.map_concat(F.map_filter(seen, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))
    )


def extract_json_state(html: Column, script_id: str) -> Column:
    """JSON text inside the script tag with this id."""
    return first_match(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>')


def expand_variants(records: DataFrame, colors: str = "colors") -> DataFrame:
    """One record per colour with the code suffixed; a record without colours stays one."""
    exploded = records.select(*[c for c in records.columns if c != colors], F.explode_outer(colors).alias("c"))
    return (
        exploded.withColumn("goodsNo", F.concat_ws("_", "goodsNo", "c.color_code"))
        .withColumn("color_name", F.col("c.color_name"))
        .withColumn(
            "url",
            F.when(F.col("c").isNotNull(), F.concat("url", F.lit("?colorDisplayCode="), "c.color_code")).otherwise(F.col("url")),
        )
        .withColumn("thumbnailImageUrl", F.coalesce(F.nullif(F.col("c.icon_url"), F.lit("")), "thumbnailImageUrl"))
        .drop("c")
    )


def selected_attributes(materials: Column) -> Column:
    """Attribute name -> name of its first selected item, '|' as space; attributes without one drop out."""
    chosen = F.transform(
        materials,
        lambda m: F.struct(
            m["name"].alias("key"),
            F.try_element_at(F.filter(m["items"], lambda i: i["isSelected"]), F.lit(1))["name"].alias("value"),
        ),
    )
    named = F.filter(chosen, lambda c: c["value"].isNotNull())
    return F.map_from_entries(
        F.transform(named, lambda c: F.struct(c["key"], F.replace(c["value"], F.lit("|"), F.lit(" "))))
    )
