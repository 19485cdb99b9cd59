"""Keyed writes into stored tables, read again; numbers that outlive a retry; keyed state kept by streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions import predicates as PR
from tallyloom.operators import aggregates as A
from tallyloom.operators import alerts as AL
from tallyloom.operators import joins as J
from tallyloom.operators import keyed as K
from tallyloom.operators import paging as G
from tallyloom.operators import postings as N
from tallyloom.operators.sequence import SequenceLedger
from tallyloom.plans import catalog as P
from tallyloom.plans import domain as D
from tallyloom.plans.domain import ACTIVITY_SQL, LOGS_SQL, PRODUCTS_SQL, with_
from tallyloom.queries import ORACLES, register
from tallyloom.queries import keyed as Q
from tallyloom.queries.activity import BOARD_SQL, board
from tallyloom.queries.catalog import PREFIX_SQL, RAW_SQL, raw_records
from tallyloom.queries.logs import AS_OF, MONTH_HOURS, RECENT_HOURS
from tallyloom.session import scratch_path
from tallyloom.sources.versioned import PartTable, bucket, day
from tallyloom.streaming import keyed as T

BUCKETS = 16


def written(spark, rows, keys, name):
    """A new stored table of ``rows``, cut by the hash of its key."""
    table = PartTable(spark, scratch_path(spark, name), bucket(keys, BUCKETS))
    table.create(rows)
    return table


def merged(spark, d, rule):
    table = written(spark, Q.base(spark, d), ["doc_id"], "stored")
    table.apply(Q.delta(spark, d), rule, batch="labels")
    table.apply(Q.delta(spark, d), rule, batch="labels")  # a repeated batch changes nothing
    return table.read()


BOTH = with_(Q.BASE_SQL, Q.DELTA_SQL)


@register("stored_upsert_full", BOTH + Q.FULL_SQL)
def stored_upsert_full(spark, d):
    return merged(spark, d, lambda old, new: K.upsert_full(old, new, ["doc_id"]))


@register(
    "stored_upsert_columns",
    BOTH
    + """SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN b.lang ELSE d.lang END AS lang, b.source, CASE WHEN d.doc_id IS NULL THEN b.n_chars END AS n_chars
FROM base b FULL OUTER JOIN delta d USING (doc_id)""",
)
def stored_upsert_columns(spark, d):
    return merged(spark, d, lambda old, new: K.upsert_columns(old, new, ["doc_id"], ["lang", "n_chars"]))


@register(
    "stored_merge_partial",
    BOTH
    + """SELECT doc_id, coalesce(d.lang, b.lang) AS lang, coalesce(d.source, b.source) AS source, b.n_chars, d.quality
FROM base b FULL OUTER JOIN delta d USING (doc_id)""",
)
def stored_merge_partial(spark, d):
    return merged(spark, d, lambda old, new: K.merge_partial(old, new, ["doc_id"]))


@register("stored_upsert_on_conflict", BOTH + Q.CONFLICT.format(lang="CASE WHEN d.doc_id IS NULL THEN b.lang ELSE d.lang END"))
def stored_upsert_on_conflict(spark, d):
    return merged(spark, d, lambda old, new: K.upsert_on_conflict(old, new, ["doc_id"], ["lang"]))


@register(
    "stored_replace_by_key",
    """WITH new_rows AS (SELECT l_orderkey, 0 AS l_linenumber, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new_rows)
UNION ALL SELECT * FROM new_rows""",
)
def stored_replace_by_key(spark, d):
    """Lines of an order give way to one line for what was returned of it."""
    rows = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), "l_returnflag")
    new_rows = rows.filter(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.sum("qty").alias("qty"))
    table = written(spark, rows.drop("l_returnflag"), ["l_orderkey"], "lines")
    table.apply(new_rows, lambda old, new: K.replace_by_key(old, new, ["l_orderkey"]))
    return table.read()


@register(
    "stored_upsert_parts",
    BOTH
    + """SELECT CAST(doc_id % 16 AS VARCHAR) AS part, CASE WHEN doc_id % 16 IN (SELECT doc_id % 16 FROM delta) THEN 2 ELSE 1 END::BIGINT AS written_by, count(*) AS rows
FROM (SELECT doc_id FROM base UNION SELECT doc_id FROM delta) GROUP BY ALL""",
)
def stored_upsert_parts(spark, d):
    """Which version wrote each part: the delta's ids are even, so half of the parts stay as they are."""
    table = PartTable(spark, scratch_path(spark, "parts"), F.pmod("doc_id", F.lit(BUCKETS)).cast("string"))
    table.create(Q.base(spark, d))
    table.apply(Q.delta(spark, d), lambda old, new: K.upsert_full(old, new, ["doc_id"]))
    path = F.input_file_name()
    rows = table.read().select(F.regexp_extract(path, r"__part=(\d+)", 1).alias("part"), F.regexp_extract(path, r"/data/0*(\d+)-", 1).cast("long").alias("written_by"))
    return rows.groupBy("part", "written_by").agg(F.count("*").alias("rows"))


LOADS_SQL = with_(RAW_SQL) + f"""SELECT load, {PREFIX_SQL} || printf('%04d', place + CASE WHEN brand = 'zara' THEN 9990 ELSE 0 END + CASE WHEN batch = 1 THEN earlier ELSE 0 END) AS product_id,
  upper(brand) AS brand_name, p_name AS prod_name
FROM (SELECT *, p_partkey // 5 % 2 AS batch, row_number() OVER (PARTITION BY brand, p_partkey // 5 % 2 ORDER BY code, file_path) AS place,
    count(*) FILTER (p_partkey // 5 % 2 = 0) OVER (PARTITION BY brand) AS earlier FROM attrs)
  JOIN (VALUES ('first', 0), ('second', 1), ('first again', 0)) l(load, of_batch) ON batch = of_batch"""


@register("load_catalog_batches", LOADS_SQL)
def load_catalog_batches(spark, d):
    """Two loads and a retry of the first: no gap, no repeat, and the same ids again."""
    ledger = SequenceLedger(spark, scratch_path(spark, "sequences"))
    ledger.create(spark.createDataFrame([("ZARA", 9990)], "brand_name string, last_seq int"), "brand_name")
    raw = raw_records(spark, d).withColumn("half", F.regexp_extract("file_path", r"_(\d+)\.json$", 1).cast("long"))
    half = F.expr("half div 5 % 2")
    as_of = F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")
    loads = None
    for load, batch in (("first", 0), ("second", 1), ("first again", 0)):
        products = P.load_catalog_batch(raw.where(half == batch).drop("half"), ledger, f"day {batch}", as_of)
        rows = products.select(F.lit(load).alias("load"), "product_id", "brand_name", "prod_name")
        loads = rows if loads is None else loads.unionByName(rows)
    return loads


def event_files(spark, d):
    """The activity of the events table as a stream of three files, one a batch."""
    path = scratch_path(spark, "activity")
    D.views_and_likes(spark, d).repartitionByRange(3, "event_id").write.parquet(path)
    return spark.readStream.schema(D.views_and_likes(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(path)


def replayed(spark, start):
    """Run a stream to its end, then all its batches once more from a fresh checkpoint."""
    for _ in range(2):
        start(scratch_path(spark, "progress")).awaitTermination()


@register("touch_latest_stream", with_(ACTIVITY_SQL) + """SELECT user_id, product_id, max("at") AS "at" FROM activity WHERE action = 'view' GROUP BY 1, 2""")
def touch_latest_stream(spark, d):
    keys = ["user_id", "product_id"]
    empty = spark.createDataFrame([], "user_id string, product_id string, at timestamp_ntz")
    table = written(spark, empty, keys, "touched")
    views = event_files(spark, d).filter(F.col("action") == "view")
    replayed(spark, lambda checkpoint: T.touch_stream(views, table, keys, "views", checkpoint))
    return table.read()


@register(
    "toggle_state_stream",
    with_(ACTIVITY_SQL.replace("event_id // 5", "event_id * 7 % 20"))
    + """SELECT user_id, product_id, max("at") AS "at" FROM activity WHERE action IN ('click', 'error') GROUP BY 1, 2
HAVING arg_max(action, event_id) = 'click'""",
)
def toggle_state_stream(spark, d):
    keys = ["user_id", "product_id"]
    empty = spark.createDataFrame([], "user_id string, product_id string, action string, at timestamp_ntz, event_id long")
    table = written(spark, empty, keys, "switched")
    events = event_files(spark, d).withColumn("product_id", (F.col("event_id") * 7 % 20).cast("string"))
    replayed(spark, lambda checkpoint: T.toggle_stream(events.filter(F.col("action").isin("click", "error")), table, keys, "likes", checkpoint))
    return table.read().filter(F.col("action") == "click").select(*keys, "at")


@register(
    "increment_counter_stream",
    with_(PRODUCTS_SQL, ACTIVITY_SQL)
    + "SELECT product_id, base_price + coalesce(n, 0) AS view_count FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM activity GROUP BY 1) USING (product_id)",
)
def increment_counter_stream(spark, d):
    board = D.products(spark, d).select("product_id", F.col("base_price").cast("long").alias("view_count"))
    table = written(spark, board, ["product_id"], "counted")
    replayed(spark, lambda checkpoint: T.counter_stream(event_files(spark, d), table, ["product_id"], "views", checkpoint))
    return table.read()


@register("dashboard_rollup_stream", ORACLES["dashboard"])
def dashboard_rollup_stream(spark, d):
    """The dashboard from hourly counts that a stream has kept; every batch holds rows of all hours, and comes twice."""
    path = scratch_path(spark, "logs")
    logs = D.logs(spark, d)
    logs.repartition(3, "event_id").write.parquet(path)
    empty = A.hourly_rollup(logs.limit(0), 256)
    table = PartTable(spark, scratch_path(spark, "rollup"), day("bucket"))
    table.create(empty)
    feed = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    replayed(spark, lambda checkpoint: T.rollup_stream(feed, table, "logs", checkpoint, 256))
    return A.dashboard_from_rollup(table.read(), AS_OF, MONTH_HOURS, RECENT_HOURS)


def daily_logs(spark, d):
    table = PartTable(spark, scratch_path(spark, "daily"), day("timestamp"))
    table.create(D.logs(spark, d))
    return table


@register("retain_days_stored", with_(LOGS_SQL) + """SELECT event_id, level FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-24 09:30:00'""")
def retain_days_stored(spark, d):
    """Seven days back from half past nine: whole days go by name, one is rewritten."""
    table = daily_logs(spark, d)
    table.keep_since("timestamp", dt.datetime(2024, 1, 31, 9, 30) - dt.timedelta(days=7))
    return table.read().select("event_id", "level")


@register("purge_cutoff_stored", with_(LOGS_SQL) + """SELECT event_id, "timestamp" FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-20 00:00:00'""")
def purge_cutoff_stored(spark, d):
    """A cutoff at midnight: no row is read to purge."""
    table = daily_logs(spark, d)
    table.keep_since("timestamp", dt.datetime(2024, 1, 20))
    return table.read().select("event_id", "timestamp")


@register("board_page_seek", BOARD_SQL + " ORDER BY create_dt DESC, post_id DESC LIMIT 20 OFFSET 1240")
def board_page_seek(spark, d):
    """The sixty-third page, from the one or two ranges that hold it."""
    rows, root = J.board_with_counts(*board(spark, d)), scratch_path(spark, "pages")
    G.build_pages(rows, [F.desc("create_dt"), F.desc("post_id")], root)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return G.seek_page(spark, root, schema, number=63, size=20)


@register("log_phrase_postings", ORACLES["log_phrase"])
def log_phrase_postings(spark, d):
    logs = D.logs(spark, d)
    table = N.build_postings(logs, "event_id", "message", scratch_path(spark, "postings"))
    found = N.phrase_documents(table, "K=1").withColumnRenamed("doc", "event_id")
    return logs.filter(PR.phrase(F.col("level"), "WARN")).join(found, "event_id", "left_semi").select("event_id", "message")


@register("text_match_postings", ORACLES["text_match_fields"])
def text_match_postings(spark, d):
    part = D.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    table = N.build_postings(part, "p_partkey", "text", scratch_path(spark, "postings"), pattern=f"[{C.KEEP_LETTERS}]+")
    return N.matched_words(table, ["Red", "ring", "PROMO", "17", "red"]).withColumnRenamed("doc", "p_partkey")


STARTS_SQL = """starts AS (SELECT service, "timestamp" AS started FROM logs WHERE message = 'signup k=0')"""


@register(
    "startup_grace_by_start",
    with_(LOGS_SQL, STARTS_SQL)
    + """SELECT event_id, level FROM logs l ASOF LEFT JOIN starts s ON l.service = s.service AND l."timestamp" >= s.started
WHERE s.started IS NULL OR l."timestamp" >= s.started + INTERVAL 6 HOUR""",
)
def startup_grace_by_start(spark, d):
    """Services start again and again; each time, six hours do not count."""
    logs = D.logs(spark, d)
    starts = logs.filter(F.col("message") == "signup k=0").select("service", "timestamp")
    return AL.after_starts(logs, starts, grace_s=6 * 3600).select("event_id", "level")
