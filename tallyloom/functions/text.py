"""Text rules for product names, codes, search phrases and filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import constants as C


def any_word(words: Sequence[str]) -> str:
    """Regular expression matching any of the words literally."""
    return "|".join(re.escape(w) for w in words)


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column; only for the fixed tables in ``constants``."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def filter_attr_keys(attrs_json: Column, words: Sequence[str] = C.NOTICE_WORDS) -> Column:
    """JSON object without the entries whose key holds a notice word; '{}' for NULL or bad JSON."""
    parsed = F.from_json(attrs_json, "map<string,string>")
    kept = F.map_filter(parsed, lambda k, _: ~k.rlike(any_word(words)))
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def digits_only_price(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), "[^0-9]", "").try_cast("int"), F.lit(0))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def brand_alias(brand: Column) -> Column:
    lowered = F.lower(brand)
    return F.coalesce(F.try_element_at(literal_map(C.BRAND_ALIAS), lowered), lowered)


def clean_model_code(code: Column) -> Column:
    """The part before the first '-', of that the part before the first '_'."""
    return F.substring_index(F.substring_index(F.trim(code), "-", 1), "_", 1)


def is_valid_code(cleaned: Column) -> Column:
    return F.coalesce(F.length(cleaned).between(1, 10), F.lit(False))


def core_tokens(name: Column, k: int | None = 3) -> Column:
    """Up to ``k`` words of the name that are neither stopwords nor all digits."""
    spaced = F.regexp_replace(name, rf"[^{C.KEEP_LETTERS}\s]", " ")
    words = F.split(F.trim(spaced), r"\s+")
    stop = F.array(*[F.lit(w) for w in C.NAME_STOPWORDS])
    kept = F.filter(
        words, lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)) & ~w.rlike("^[0-9]+$")
    )
    return kept if k is None else F.slice(kept, 1, k)


def core_keywords(name: Column, k: int = 3) -> Column:
    """Core words joined by a space; the name itself where none is left, '' for a missing name."""
    tokens = core_tokens(name, k)
    return F.when(F.coalesce(name, F.lit("")) == "", "").when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(name)


def search_queries(brand: Column, name: Column, code: Column) -> Column:
    """Up to four ``(ord, kind, query)`` structs; a phrase that is only the brand is left out."""
    english, local = F.lower(brand), brand_alias(brand)
    core, cleaned = core_keywords(name), clean_model_code(code)
    has_core, has_code = core != "", is_valid_code(cleaned)

    def entry(position: int, prefix: Column, tail: Column, present: Column) -> Column:
        return F.struct(
            F.lit(position).alias("ord"),
            F.lit(C.QUERY_KINDS[position]).alias("kind"),
            F.when(present, F.trim(F.concat_ws(" ", prefix, tail))).alias("query"),
        )

    entries = F.array(
        entry(0, local, core, has_core),
        entry(1, english, core, has_core),
        entry(2, local, cleaned, has_code),
        entry(3, english, cleaned, has_code),
    )
    return F.filter(
        entries,
        lambda e: e["query"].isNotNull()
        & (F.trim(F.replace(F.replace(e["query"], local, F.lit("")), english, F.lit(""))) != ""),
    )


def norm_text(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, f"[^{C.KEEP_LETTERS}]", ""))


def strip_markup(title: Column) -> Column:
    return F.regexp_replace(title, "</?b>", "")


def normal_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normalised texts: 1.0 where ``a`` is inside ``b``, else 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    other = F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))
    return F.when((a != "") & F.contains(b, a), F.lit(1.0)).otherwise(other)


def title_similarity(name: Column, title: Column) -> Column:
    """Similarity of a product name and an offer title; 0 where either is empty."""
    name, title = F.coalesce(name, F.lit("")), F.coalesce(title, F.lit(""))
    return F.when((name == "") | (title == ""), F.lit(0.0)).otherwise(normal_similarity(norm_text(name), norm_text(title)))


def expand_category(values: Column) -> Column:
    """Every spelling the given category words are stored under, in order, once each."""
    alias = F.create_map(
        *[x for k, v in C.CATEGORY_SEARCH_ALIAS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]
    )
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")

    return F.array_distinct(
        F.flatten(
            F.transform(
                trimmed,
                lambda w: F.coalesce(
                    F.try_element_at(alias, F.lower(w)),
                    F.array(
                        w,
                        F.lower(w),
                        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))),
                    ),
                ),
            )
        )
    )


def expand_category_code(category: Column) -> Column:
    """Lower-case spellings a stored category code may have; empty for a blank category."""
    alias = F.create_map(
        *[x for k, v in C.CATEGORY_CODE_ALIAS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]
    )
    key = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(F.try_element_at(alias, key), F.array(key))
    )


def parse_filter_list(value: Column) -> Column:
    """NULL for NULL or blank; otherwise the trimmed non-empty parts of a comma list."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def split_legacy_filter(category: Column, gender: Column) -> tuple[Column, Column]:
    """``gender_category`` in one field, split on the first '_' where no gender is given."""
    joined = F.contains(category, F.lit("_")) & (F.coalesce(gender, F.lit("")) == "")
    parts = F.split(category, "_", 2)
    return F.when(joined, parts[0]).otherwise(gender), F.when(joined, parts[1]).otherwise(category)


def rewrite_gate(text: Column, has_image: Column, category: Column, longest: int = 20) -> Column:
    """May this query text be rewritten?"""
    base = F.trim(F.coalesce(text, F.lit("")))
    return (
        (base != "")
        & (F.length(base) <= longest)
        & ~has_image
        & (F.trim(F.coalesce(category, F.lit(""))) == "")
        & ~base.rlike(C.MODEL_CODE)
    )


def extract_json_payload(text: Column) -> Column:
    """From the first '{' to the last '}', where that is valid JSON; otherwise NULL."""
    unfenced = F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    body = F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)


def absolute_url(url: Column, host: str) -> Column:
    return (
        F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(F.lit(host), url))
        .otherwise(url)
    )


def clean_title(title: Column, rules: Sequence[str]) -> Column:
    for rule in rules:
        title = F.regexp_replace(title, rule, "")
    return F.trim(title)


def safe_filename(name: Column) -> Column:
    return F.rtrim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))
