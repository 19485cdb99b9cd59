"""Analysed documents: names, ids, normal form, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import documents as DF
from tallyloom.operators import infer as I
from tallyloom.operators import joins as J
from tallyloom.operators import ranking as R
from tallyloom.plans import domain as D
from tallyloom.plans.domain import with_
from tallyloom.queries import register

FILES_SQL = """files AS (SELECT doc_id, lang, source, text, CASE doc_id % 6
    WHEN 0 THEN 'zara_Men_Top_' || CAST(doc_id AS VARCHAR) || '.jpg' WHEN 1 THEN 'in/zara_women_Bottom_' || CAST(doc_id AS VARCHAR) || '_0.jpg'
    WHEN 2 THEN source || '_x_' || CAST(doc_id + 100 AS VARCHAR) || '.png' WHEN 3 THEN 'single' || CAST(doc_id AS VARCHAR) || '.jpg'
    WHEN 4 THEN 'a_b_c_12345.jpg' ELSE source || '_MEN_OUTER_code' || CAST(doc_id AS VARCHAR) || '_extra_07.jpg' END AS filename FROM documents)"""


def files(spark, d):
    key, text = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    name = (
        F.when(key == 0, F.concat(F.lit("zara_Men_Top_"), text, F.lit(".jpg")))
        .when(key == 1, F.concat(F.lit("in/zara_women_Bottom_"), text, F.lit("_0.jpg")))
        .when(key == 2, F.concat("source", F.lit("_x_"), (F.col("doc_id") + 100).cast("string"), F.lit(".png")))
        .when(key == 3, F.concat(F.lit("single"), text, F.lit(".jpg")))
        .when(key == 4, "a_b_c_12345.jpg")
        .otherwise(F.concat("source", F.lit("_MEN_OUTER_code"), text, F.lit("_extra_07.jpg")))
    )
    return D.table(spark, d, "documents").select("doc_id", "lang", "source", "text", name.alias("filename"))


@register(
    "parse_image_names",
    with_(FILES_SQL)
    + r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zara' WHEN 1 THEN 'zara' WHEN 5 THEN source ELSE lang END AS brand,
  CASE doc_id % 6 WHEN 0 THEN 'Men' WHEN 1 THEN 'women' WHEN 5 THEN 'MEN' ELSE 'unknown' END AS gender,
  CASE doc_id % 6 WHEN 0 THEN 'Top' WHEN 1 THEN 'Bottom' WHEN 5 THEN 'OUTER' ELSE 'unknown' END AS category,
  CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id + 100 AS VARCHAR)
    WHEN 3 THEN 'single' || CAST(doc_id AS VARCHAR) WHEN 4 THEN '12345' ELSE 'code' || CAST(doc_id AS VARCHAR) END AS product_code,
  split_part(split_part(filename, '.', 1), '_', 1) || '_' || coalesce(nullif(split_part(split_part(filename, '.', 1), '_', 4), ''), 'Unknown') AS lenient_id,
  coalesce(nullif(split_part(split_part(filename, '.', 1), '_', 2), ''), 'Unknown') AS lenient_gender,
  CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id < 100 THEN 'Top' ELSE CAST(doc_id AS VARCHAR) END WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id + 100 AS VARCHAR)
    WHEN 3 THEN 'single' || CAST(doc_id AS VARCHAR) WHEN 4 THEN '12345' ELSE 'extra' END AS file_code
FROM files""",
)
def parse_image_names(spark, d):
    strict = DF.parse_image_name(F.col("filename"), F.col("lang"))
    lenient = DF.parse_image_name_lenient(F.col("filename"))
    return files(spark, d).select(
        "doc_id",
        strict["brand"].alias("brand"),
        strict["gender"].alias("gender"),
        strict["category"].alias("category"),
        strict["product_code"].alias("product_code"),
        lenient["product_id"].alias("lenient_id"),
        lenient["gender"].alias("lenient_gender"),
        DF.code_from_filename(F.col("filename")).alias("file_code"),
    )


@register(
    "normalise_docs",
    with_(FILES_SQL)
    + """SELECT doc_id, coalesce(top_brand, lang) AS brand, CASE WHEN doc_id % 2 = 0 THEN 'men' ELSE 'women' END AS gender, source AS category,
  CASE WHEN doc_id % 9 = 0 THEN 'given' ELSE file_code END AS product_code,
  CASE WHEN doc_id % 7 = 0 THEN 'id' || CAST(doc_id AS VARCHAR) WHEN trim(coalesce(top_brand, lang)) = '' THEN CASE WHEN doc_id % 9 = 0 THEN 'given' ELSE file_code END
    ELSE trim(coalesce(top_brand, lang)) || '_' || CASE WHEN doc_id % 9 = 0 THEN 'given' ELSE file_code END END AS product_id,
  filename AS image_filename
FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN ' acme ' END AS top_brand,
   CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id < 100 THEN 'Top' ELSE CAST(doc_id AS VARCHAR) END WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id + 100 AS VARCHAR)
    WHEN 3 THEN 'single' || CAST(doc_id AS VARCHAR) WHEN 4 THEN '12345' ELSE 'extra' END AS file_code FROM files)""",
)
def normalise_docs(spark, d):
    key = F.col("doc_id")
    docs = files(spark, d).select(
        "doc_id",
        F.struct(key.alias("$oid")).alias("_id"),
        F.when(key % 5 == 0, " ").when(key % 5 == 1, " acme ").alias("brand"),
        F.struct(
            F.col("lang").alias("brand"),
            F.when(key % 2 == 0, "men").otherwise("women").alias("gender"),
            F.col("source").alias("original_category"),
            F.struct(F.col("filename").alias("p")).alias("image_path"),
        ).alias("basic_info"),
        F.when(key % 9 == 0, "given").alias("product_code"),
        F.when(key % 7 == 0, F.concat(F.lit("id"), key.cast("string"))).alias("product_id"),
        "filename",
    )
    return DF.normalise_doc(docs).select("doc_id", "brand", "gender", "category", "product_code", "product_id", "image_filename")


@register(
    "embedding_texts",
    """SELECT d.doc_id, '브랜드: ' || source || ', 성별: ' || CASE WHEN toxic = 1 THEN 'men' ELSE 'None' END || ', 카테고리: ' || lang || ', 상황: ' ||
  CASE WHEN quality = 1 THEN 'work, ' || lang ELSE '' END || ', 설명: ' || text AS text_input
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def embedding_texts(spark, d):
    docs = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left")
    occasions = F.when(F.col("quality") == 1, F.array(F.lit("work"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    gender = F.when(F.col("toxic") == 1, "men")
    return docs.select(
        "doc_id", DF.embedding_text(F.col("source"), gender, F.col("lang"), occasions, F.col("text")).alias("text_input")
    )


MERGE_SIDES = """a AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source, n_chars FROM documents),
b AS (SELECT doc_id * 2 AS doc_id, CASE WHEN quality = 1 THEN 'new' END AS source, toxic FROM labels)"""


def sides(spark, d):
    a = D.table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"), "n_chars")
    b = D.table(spark, d, "labels").select(
        (F.col("doc_id") * 2).alias("doc_id"), F.when(F.col("quality") == 1, "new").alias("source"), "toxic"
    )
    return a, b


def _merge(how: str, join: str) -> None:
    @register(
        f"merge_docs_{how}",
        with_(MERGE_SIDES)
        + f"SELECT doc_id, lang, n_chars, toxic, CASE WHEN r THEN b2.source ELSE a.source END AS source FROM a {join} JOIN (SELECT *, TRUE AS r FROM b) b2 USING (doc_id)",
    )
    def merge(spark, d):
        return J.merge_docs(*sides(spark, d), "doc_id", how)


for _how, _join in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    _merge(_how, _join)


@register(
    "last_wins_by_id",
    "SELECT source AS id, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1",
)
def last_wins_by_id(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("source").alias("id"), "doc_id", "lang", "n_chars")
    return R.last_wins(docs, ["id"], "doc_id")


@register("without_error_docs", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic = 1, FALSE)")
def without_error_docs(spark, d):
    docs = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left")
    error = F.when(F.col("toxic") == 1, "toxic")
    return docs.filter(~DF.is_error_doc(error)).select("doc_id")


@register(
    "sync_docs",
    """SELECT CAST(vec_id AS VARCHAR) AS id, 'f' || CAST(vec_id AS VARCHAR) AS filename, 'b' || CAST(label % 3 AS VARCHAR) AS brand, 'c' || CAST(label AS VARCHAR) AS category,
  CASE WHEN vec_id % 4 = 0 THEN '' ELSE 'text' END AS description, 'f' || CAST(vec_id AS VARCHAR) AS image_url, vec_id % 2 = 0 AS has_image, vec_id % 3 = 0 AS has_text
FROM embeddings WHERE label % 3 = 1 AND (vec_id % 2 = 0 OR vec_id % 3 = 0)""",
)
def sync_docs(spark, d):
    key = F.col("vec_id")
    docs = D.table(spark, d, "embeddings").select(
        key.alias("product_id"),
        F.concat(F.lit("f"), key.cast("string")).alias("filename"),
        F.struct(
            F.concat(F.lit("b"), (F.col("label") % 3).cast("string")).alias("brand"),
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("original_category"),
        ).alias("basic_info"),
        F.struct(F.when(key % 4 != 0, "text").alias("description")).alias("analysis"),
        F.when(key % 2 == 0, F.col("embedding")).alias("image_vector"),
        F.when(key % 3 == 0, F.col("embedding")).alias("text_vector"),
    )
    return (
        I.sync_docs(docs, "B1")
        .withColumn("has_image", F.col("vec_image").isNotNull())
        .withColumn("has_text", F.col("vec_text").isNotNull())
        .drop("vec_image", "vec_text")
    )


@register("dedupe_by_content", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_content(spark, d):
    return I.dedupe_by_content(D.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
