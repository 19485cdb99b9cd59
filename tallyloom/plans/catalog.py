"""Catalog load: five sources, one shape.

Each source only states where it differs. All sources of a day are read once
and numbered together, by brand, so the load is one range exchange for everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import catalog as G
from tallyloom.functions.text import filter_attr_keys
from tallyloom.operators.sequence import SequenceLedger, assign_sequence, next_sequences


@dataclass(frozen=True)
class Source:
    """How one brand's records become catalog rows."""

    brand: str
    prefix: str
    lower_attrs: bool = True
    joined_category: bool = False
    code_columns: tuple[str, ...] = ("goodsNo",)
    url_columns: tuple[str, ...] = ("url",)
    url_prefix: str | None = None
    skip_null_names: bool = False
    image_positions: tuple[int, ...] = (1,)
    use_thumbnail: str = "never"  # never, first or only
    filter_attrs: bool = False


# The sources and their rules.
SOURCES = (
    Source("8seconds", "8S", image_positions=(3, 5), skip_null_names=True, filter_attrs=True),
    Source("musinsa", "MS", lower_attrs=False, code_columns=("product_code", "goodsNo"), url_columns=("url", "scraped_url"), use_thumbnail="only"),
    Source("topten", "TT", joined_category=True),
    Source("uniqlo", "UQ", lower_attrs=False, code_columns=("display_goods_no", "goodsNo"), url_columns=("url", "scraped_url")),
    Source("zara", "ZR", url_prefix="https://www.zara.com/kr/ko/share/-p", use_thumbnail="first"),
)


def source_columns(source: Source) -> dict[str, Column]:
    """Canonical columns of one source; the raw columns they read must exist."""
    gender, sub = G.attrs_from_path(F.col("file_path"), source.brand, source.lower_attrs)
    code = F.col("goodsNo")
    name = G.image_name(F.lit(source.brand), gender, sub, code, source.skip_null_names)
    url = (
        G.url_from_code(source.url_prefix, code, ".html")
        if source.url_prefix
        else G.origin_url(*[F.col(c) for c in source.url_columns])
    )
    thumbnail = F.col("thumbnailImageUrl")
    if source.use_thumbnail == "only":
        image = thumbnail
    else:
        image = G.image_source_url(
            F.col("goodsImages"), source.image_positions, thumbnail if source.use_thumbnail == "first" else None
        )
    attrs = F.to_json("goodsMaterial")
    return {
        "brand_name": F.lit(source.brand.upper()),
        "prefix": F.lit(source.prefix),
        "goods_no": code,
        "file_path": F.col("file_path"),
        "model_code": G.coalesce_key(*[F.col(c) for c in source.code_columns]),
        "prod_name": F.col("goodsNm"),
        "base_price": G.int_or_zero(F.col("price")),
        "gender": gender,
        "category_code": G.category_code(gender, sub, source.joined_category),
        "img_hdfs_path": G.image_path(f"/raw/{source.brand}/image", name, ".jpg" if source.skip_null_names else ""),
        "origin_url": url,
        "target_img_url": image,
        "detail_desc": filter_attr_keys(attrs) if source.filter_attrs else attrs,
    }


def catalog_rows(raw: DataFrame, sources: tuple[Source, ...] = SOURCES) -> DataFrame:
    """Canonical rows of records with a column ``brand``; one pass, each row by its source's rules.

    Records of other brands are left out.
    """
    rules = {s.brand: source_columns(s) for s in sources}

    def value(name: str) -> Column:
        out = None
        for brand, columns in rules.items():
            out = (F if out is None else out).when(F.col("brand") == brand, columns[name])
        return out.alias(name)

    names = next(iter(rules.values()))
    return raw.filter(F.col("brand").isin(list(rules))).select(*[value(name) for name in names])


def load_catalog(
    raw: DataFrame, last_seq: DataFrame, as_of: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Products with surrogate ids, and the sequence table after the load.

    Numbers follow ``goodsNo``; equal codes are ordered by file path, so that
    ids do not depend on how rows were read.
    """
    numbered = assign_sequence(catalog_rows(raw), ["goods_no", "file_path"], "brand_name", last_seq)
    identity = G.surrogate_id(F.col("prefix"), F.col("seq"))
    products = numbered.withColumn("product_id", identity).select(
        "product_id",
        *[c for c in numbered.columns if c not in ("prefix", "goods_no", "file_path", "seq")],
        *G.audit_columns(as_of),
    )
    return products, next_sequences(numbered, "brand_name")


def load_catalog_batch(raw: DataFrame, ledger: SequenceLedger, batch: str, as_of: Column | None = None) -> DataFrame:
    """Products of one batch, with the ids its ledger holds for it: a load that is repeated gives the same ids."""
    counts = catalog_rows(raw).groupBy("brand_name").agg(F.count("*").alias("n"))
    return load_catalog(raw, ledger.reserve(batch, counts, "brand_name"), as_of)[0]
