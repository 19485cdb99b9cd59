"""Registered queries of the ten operators and the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    decontamination,
    langid,
    licenses,
    merkle,
    mixture,
    neighbours,
    ordermin,
    packing,
    pages,
    pii,
    quality,
    simhash,
    spelling,
    sql,
)
from tallyloom.llm.common import load, prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = lambda spark, sf_dir: query(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The same mix in SQL: water level, systematic sampling by exact counts.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'T' ELSE 'S' || source END AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT source, source_size, weight,
         ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER before, 0))
         / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY (2 * source_size)::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY len(d.size::VARCHAR) * 100 + substr(d.size::VARCHAR, 1, 2)::INT,
            substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 2), d.size, d.doc_id NULLS FIRST) - 1)::DOUBLE AS place,
         ('0x' || substr(md5('mix-1' || d.source), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS off
  FROM d JOIN t ON d.source = t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate * (place + 1) + off) - floor(rate * place + off)) AS BIGINT) AS taken
FROM p
"""


@register("op1_order_minhash")
def order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compared(load(spark, sf_dir, "documents"))


@register("op2_multiprobe_lsh")
def multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register("op3_source_mixture", MIX_SQL)
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixture.copies(load(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@register("op4_mixture_packing")
def mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), tokenizer())


@register("op5_byte_cnn_quality")
def byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = quality.fit(docs, labels.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), quality.scored(docs, network).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op6_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "pages").select("page_id", "url", pages.extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    models = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identified(models, docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.cross_entropy", "found.rejected")


@register("op8_license_scan", licenses.scan_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(load(spark, sf_dir, "documents"))


@register("op9_pii_sanitisation")
def pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(load(spark, sf_dir, "documents"))


@register("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op11_benchmark_decontamination", sql.DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.found(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op12_merkle_manifest", sql.MANIFEST)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(load(spark, sf_dir, "documents"), tampered, lowered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@register("op13_spelling_variants", sql.SPELLING)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(load(spark, sf_dir, "documents"), 97).select("word", "form", "root", "n", "n_near", "form_n")
