"""Reports: flat and nested match results, log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions import predicates as P
from tallyloom.operators.ranking import newest


def flat_matches(products: DataFrame, matched: DataFrame) -> DataFrame:
    """Product x offer rows as text; a product without offers is one row of placeholders."""
    o = matched.select(
        "product_id",
        F.col("rank").cast("string").alias("rank"),
        F.col("title").alias("offer_title"),
        F.col("price").cast("string").alias("offer_price"),
        "mall_name",
        "mall_url",
    )
    dash = F.lit("-")
    return products.select("product_id", "brand_name", "model_code", "prod_name", "base_price").join(
        o, "product_id", "left"
    ).select(
        "product_id",
        F.lower("brand_name").alias("brand"),
        "model_code",
        F.col("prod_name").alias("original_name"),
        F.col("base_price").alias("original_price"),
        F.coalesce("rank", dash).alias("rank"),
        F.when(F.col("rank").isNull(), C.NO_RESULT).otherwise(F.col("offer_title")).alias("offer_title"),
        F.coalesce("offer_price", dash).alias("offer_price"),
        F.coalesce("mall_name", dash).alias("mall_name"),
        F.coalesce("mall_url", dash).alias("mall_url"),
    )


def export_csv_topk(products: DataFrame, matched: DataFrame, path: str) -> None:
    flat_matches(products, matched).write.mode("overwrite").option("header", True).csv(path)


def nested_matches(products: DataFrame, matched: DataFrame) -> DataFrame:
    """One document per product: its info and its ranked offers (at most five)."""
    offers = matched.groupBy("product_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("rank").alias("final_rank"), "title", "price", "mall_name", "mall_url"))
        ).alias("o")
    )
    info = F.struct(
        F.lower("brand_name").alias("brand"), "model_code", "prod_name", F.col("base_price").alias("original_price")
    )
    return products.join(offers, "product_id", "left").select(
        "product_id",
        info.alias("original_info"),
        F.coalesce("o", F.array().cast(offers.schema["o"].dataType)).alias("top_5_results"),
    )


def export_json_nested(products: DataFrame, matched: DataFrame, path: str) -> None:
    nested_matches(products, matched).write.mode("overwrite").json(path)


def log_line() -> Column:
    """``[time] [level] [service] container - message`` on one line."""
    return F.format_string(
        "[%s] [%s] [%s] %s - %s",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.coalesce("level", F.lit("INFO")),
        F.coalesce("service", F.lit("unknown")),
        F.coalesce("container", F.lit("unknown")),
        F.regexp_replace(F.coalesce("message", F.lit("")), "\n", "  "),
    )


def log_text(
    logs: DataFrame,
    service: str | None = None,
    level: str | None = None,
    keyword: str | None = None,
    size: int | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """The newest ``size`` matching lines as text, newest first; by default all."""
    condition = P.all_of(
        P.phrase(F.col("service"), service), P.phrase(F.col("level"), level), P.text_phrase(F.col("message"), keyword)
    )
    found = logs.filter(condition)
    found = found.orderBy(F.desc("timestamp"), F.desc(tie)) if size is None else newest(found, "timestamp", size, tie)
    return found.select(log_line().alias("line"))


def export_log_text(logs: DataFrame, path: str, **rules) -> None:
    log_text(logs, **rules).write.mode("overwrite").text(path)
