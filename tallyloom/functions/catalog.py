"""Catalog projections: attributes from paths, keys, names, prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.constants import IN_STOCK_QTY


def attrs_from_path(path: Column, brand: str, lower: bool = True) -> tuple[Column, Column]:
    """Gender and sub-category out of ``brand_gender_category_code.json``; '' without a match."""
    gender = F.regexp_extract(path, f"{brand}_([^_]+)_", 1)
    category = F.regexp_extract(path, f"{brand}_[^_]+_([^_]+)_", 1)
    return (F.lower(gender), F.lower(category)) if lower else (gender, category)


def category_code(gender: Column, sub_category: Column, joined: bool = False) -> Column:
    """The sub-category, or ``gender_sub`` (NULL as soon as one part is NULL)."""
    return F.concat(gender, F.lit("_"), sub_category) if joined else sub_category


def zero_padded(number: Column, width: int) -> Column:
    """Decimal text of at least ``width`` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def surrogate_id(prefix: str | Column, number: Column) -> Column:
    """``PREFIX`` and the number, zero-padded to four digits and longer where needed."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, zero_padded(number, 4))


def image_name(brand: Column, gender: Column, category: Column, code: Column, skip_nulls: bool = True) -> Column:
    parts = [brand, gender, category, code]
    if skip_nulls:
        return F.concat_ws("_", *parts)
    return F.concat(parts[0], *[piece for p in parts[1:] for piece in (F.lit("_"), p)], F.lit(".jpg"))


def image_path(folder: str, name: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(suffix))


def origin_url(*urls: Column) -> Column:
    return F.coalesce(*urls)


def url_from_code(prefix: str, code: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), code, F.lit(suffix))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def price_or_zero(value: Column) -> Column:
    """``int(float(x))``: text to double, cut toward zero; anything unreadable is 0."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))


def coalesce_key(*keys: Column) -> Column:
    return F.coalesce(*keys)


def image_source_url(images: Column, positions: Sequence[int] = (1,), thumbnail: Column | None = None) -> Column:
    """First present of: the thumbnail (where given), then the listed array positions."""
    options = [] if thumbnail is None else [thumbnail]
    options += [F.try_element_at(images, F.lit(p)) for p in positions]
    return F.coalesce(*options)


def audit_columns(as_of: Column | None = None) -> list[Column]:
    stamp = F.current_timestamp() if as_of is None else as_of
    return [stamp.alias("create_dt"), stamp.alias("update_dt")]


def sold_out_flag(price: Column, markers: Column) -> Column:
    """Sold out when the price is 0 or any marker in the array is set."""
    return (price == 0) | F.coalesce(F.exists(markers, lambda m: m), F.lit(False))


def stock_qty(is_sold_out: Column) -> Column:
    return F.when(is_sold_out, F.lit(0)).otherwise(F.lit(IN_STOCK_QTY))


def discount(base: Column, price: Column) -> tuple[Column, Column]:
    """Difference and its percentage of the base cut toward zero; 0 percent without a base."""
    difference = base - price
    rate = F.when(base > 0, (difference / base * 100).cast("int")).otherwise(F.lit(0))
    return difference, rate
