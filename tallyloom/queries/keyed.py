"""Keyed writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import keyed as K
from tallyloom.plans import domain as D
from tallyloom.plans.domain import ACTIVITY_SQL, LOGS_SQL, PRODUCTS_SQL, with_
from tallyloom.queries import register

# Base: documents with even or small ids. Delta: labels, shifted, some fields absent.
BASE_SQL = "base AS (SELECT doc_id, lang, source, n_chars FROM documents)"
DELTA_SQL = """delta AS (SELECT doc_id * 2 AS doc_id, CASE WHEN quality = 1 THEN 'xx' END AS lang, 'upd' || CAST(toxic AS VARCHAR) AS source, quality FROM labels)"""


def base(spark, d):
    return D.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


def delta(spark, d):
    return D.table(spark, d, "labels").select(
        (F.col("doc_id") * 2).alias("doc_id"),
        F.when(F.col("quality") == 1, "xx").alias("lang"),
        F.concat(F.lit("upd"), F.col("toxic").cast("string")).alias("source"),
        "quality",
    )


FULL_SQL = """SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN b.lang ELSE d.lang END AS lang,
  CASE WHEN d.doc_id IS NULL THEN b.source ELSE d.source END AS source, b.n_chars, d.quality
FROM base b FULL OUTER JOIN delta d USING (doc_id)"""


@register("upsert_full", with_(BASE_SQL, DELTA_SQL) + FULL_SQL)
def upsert_full(spark, d):
    return K.upsert_full(base(spark, d), delta(spark, d), ["doc_id"])


@register("upsert_full_small_delta", with_(BASE_SQL, DELTA_SQL) + FULL_SQL)
def upsert_full_small_delta(spark, d):
    return K.upsert_full(base(spark, d), delta(spark, d), ["doc_id"], small_delta=True)


@register(
    "upsert_columns",
    with_(BASE_SQL, DELTA_SQL)
    + """SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN b.lang ELSE d.lang END AS lang, b.source,
  CASE WHEN d.doc_id IS NULL THEN b.n_chars END AS n_chars
FROM base b FULL OUTER JOIN delta d USING (doc_id)""",
)
def upsert_columns(spark, d):
    return K.upsert_columns(base(spark, d), delta(spark, d), ["doc_id"], ["lang", "n_chars"])


@register(
    "merge_partial",
    with_(BASE_SQL, DELTA_SQL)
    + """SELECT doc_id, coalesce(d.lang, b.lang) AS lang, coalesce(d.source, b.source) AS source, b.n_chars, d.quality
FROM base b FULL OUTER JOIN delta d USING (doc_id)""",
)
def merge_partial(spark, d):
    return K.merge_partial(base(spark, d), delta(spark, d), ["doc_id"])


CONFLICT = """SELECT doc_id, {lang} AS lang, CASE WHEN b.doc_id IS NULL THEN d.source ELSE b.source END AS source, b.n_chars,
  CASE WHEN b.doc_id IS NULL THEN d.quality END AS quality
FROM base b FULL OUTER JOIN delta d USING (doc_id)"""


@register("upsert_on_conflict", with_(BASE_SQL, DELTA_SQL) + CONFLICT.format(lang="CASE WHEN d.doc_id IS NULL THEN b.lang ELSE d.lang END"))
def upsert_on_conflict(spark, d):
    return K.upsert_on_conflict(base(spark, d), delta(spark, d), ["doc_id"], ["lang"])


@register("upsert_keep_old_when_null", with_(BASE_SQL, DELTA_SQL) + CONFLICT.format(lang="coalesce(d.lang, b.lang)"))
def upsert_keep_old_when_null(spark, d):
    return K.upsert_on_conflict(base(spark, d), delta(spark, d), ["doc_id"], ["lang"], keep_old_when_null=True)


@register(
    "insert_ignore",
    with_(BASE_SQL, DELTA_SQL)
    + """SELECT doc_id, lang, source, n_chars, NULL::INTEGER AS quality FROM base
UNION ALL SELECT doc_id, lang, source, NULL, quality FROM delta WHERE doc_id NOT IN (SELECT doc_id FROM base)""",
)
def insert_ignore(spark, d):
    return K.insert_ignore(base(spark, d), delta(spark, d), ["doc_id"])


@register("touch_latest", with_(ACTIVITY_SQL) + """SELECT user_id, product_id, max("at") AS "at" FROM activity WHERE action = 'view' GROUP BY 1, 2""")
def touch_latest(spark, d):
    views = D.views_and_likes(spark, d).filter(F.col("action") == "view")
    return K.touch_latest(views, ["user_id", "product_id"])


@register(
    "toggle_state",
    with_(ACTIVITY_SQL.replace("event_id // 5", "event_id * 7 % 20"))
    + """SELECT user_id, product_id, max("at") AS "at" FROM activity WHERE action IN ('click', 'error') GROUP BY 1, 2
HAVING arg_max(action, event_id) = 'click'""",
)
def toggle_state(spark, d):
    events = D.views_and_likes(spark, d).withColumn("product_id", (F.col("event_id") * 7 % 20).cast("string"))
    return K.toggle_state(events.filter(F.col("action").isin("click", "error")), ["user_id", "product_id"], "click")


@register(
    "replace_by_key",
    """WITH new_rows AS (SELECT l_orderkey, 0 AS l_linenumber, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new_rows)
UNION ALL SELECT * FROM new_rows""",
)
def replace_by_key(spark, d):
    rows = D.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag"
    )
    new_rows = rows.filter(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.sum("qty").alias("qty"))
    return K.replace_by_key(rows.drop("l_returnflag"), new_rows.withColumn("l_linenumber", F.lit(0)), ["l_orderkey"])


@register(
    "cascade_delete",
    """WITH doomed AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
SELECT 'products' AS t, count(*) AS rows FROM part WHERE p_partkey NOT IN (SELECT * FROM doomed)
UNION ALL SELECT 'features', count(*) FROM part WHERE p_partkey NOT IN (SELECT * FROM doomed)
UNION ALL SELECT 'offers', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT * FROM doomed)
UNION ALL SELECT 'search_logs', count(*) FROM orders WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT * FROM doomed))""",
)
def cascade_delete(spark, d):
    part = D.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_type")
    line = D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("offer_id"))
    orders = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("offer_id"))
    left = K.cascade_delete(
        {"products": part, "features": part, "offers": line, "search_logs": orders},
        part.filter(F.col("p_type") == "PROMO").select("product_id"),
    )
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("t"), "rows") for n, df in left.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@register("delete_where", "SELECT event_id, user_id FROM events WHERE user_id <> 42")
def delete_where(spark, d):
    return K.delete_where(D.table(spark, d, "events").select("event_id", "user_id"), F.col("user_id") == 42)[0]


@register("delete_where_count", "SELECT count(*) AS deleted_count FROM events WHERE user_id = 42")
def delete_where_count(spark, d):
    return K.delete_where(D.table(spark, d, "events"), F.col("user_id") == 42)[1]


@register("purge_cutoff", with_(LOGS_SQL) + """SELECT event_id, "timestamp" FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-20 12:00:00'""")
def purge_cutoff(spark, d):
    return K.purge_cutoff(D.logs(spark, d), "timestamp", dt.datetime(2024, 1, 20, 12)).select("event_id", "timestamp")


@register("retain_days", with_(LOGS_SQL) + """SELECT event_id, level FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-24 00:00:00'""")
def retain_days(spark, d):
    return K.retain_days(D.logs(spark, d), "timestamp", 7, dt.datetime(2024, 1, 31)).select("event_id", "level")


@register(
    "increment_counter",
    with_(PRODUCTS_SQL, ACTIVITY_SQL)
    + "SELECT product_id, base_price + coalesce(n, 0) AS view_count FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM activity GROUP BY 1) USING (product_id)",
)
def increment_counter(spark, d):
    board = D.products(spark, d).select("product_id", F.col("base_price").cast("long").alias("view_count"))
    return K.increment_counter(board, D.views_and_likes(spark, d), ["product_id"])


@register(
    "evolve_schema",
    "SELECT p_partkey, p_name AS prod_name, NULL::VARCHAR AS gender, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def evolve_schema(spark, d):
    part = D.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    rules = dict(
        rename={"p_name": "prod_name"}, add={"gender": "string", "p_retailprice": "double"}, drop=["p_brand"], widen={"p_size": "bigint"}
    )
    return K.evolve_schema(K.evolve_schema(part, **rules), **rules)
