"""Streams over the given tables: files in, one pass, parquet in the shared folder out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.plans import domain as D
from tallyloom.plans.domain import LOGS_SQL, METRICS_SQL, with_
from tallyloom.queries import ORACLES, register
from tallyloom.queries.alerts import DECIDED_SQL, RATE, RECOVERY, RESTARTABLE
from tallyloom.queries.logs import SUMS
from tallyloom.session import scratch_path
from tallyloom.sources import streams as S
from tallyloom.streaming import alerts as A
from tallyloom.streaming import logs as L


def event_stream(spark, d):
    """The events table as a file stream that ends: a last event, a day later, closes every window before it.

    That event is of no interest itself (id -1, a page view).
    """
    events = D.table(spark, d, "events")
    kept = [F.col(c) for c in events.columns if c not in ("event_id", "ts", "event_type")]
    end = events.agg(F.max_by(F.struct(*kept), "ts").alias("r"), F.max("ts").alias("last")).select(
        F.lit(-1).cast("long").alias("event_id"), F.expr("last + interval 1 day").alias("ts"), F.lit("view").alias("event_type"), "r.*"
    )
    path = scratch_path(spark, "feed")
    events.unionByName(end).write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def log_stream(spark, d):
    service = (F.col("user_id") % 8).cast("string")
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "CRITICAL").otherwise("INFO")
    return event_stream(spark, d).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("svc-"), service, F.lit("-main")).alias("container"),
        F.concat(F.lit("svc"), service).alias("service"),
        level.alias("level"),
        F.concat("event_type", F.lit(" k="), F.get_json_object("props", "$.k")).alias("message"),
    )


def run_once(stream, spark, name: str):
    """Everything there is, batch by batch, then what was stored."""
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    S.micro_batch_sink(stream, S.store_batches(out), checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def shipped(spark, d):
    """Logs as a shipper would send them, as JSON lines in the shared folder."""
    logs = D.logs(spark, d)
    key = F.col("event_id") % 4
    message = F.when(key == 0, F.concat(F.lit('{"s":"E","msg":"'), "message", F.lit('"}'))).otherwise(F.col("message"))
    rows = logs.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        message.alias("message"),
        F.when(key == 0, F.struct(F.concat(F.lit("/"), "container").alias("name"))).alias("container"),
        F.when(key == 1, F.struct(F.struct(F.col("container").alias("name")).alias("container"))).alias("docker"),
        F.when(key == 2, F.struct(F.col("container").alias("container"))).alias("fields"),
        F.when(key == 3, F.struct(F.struct(F.concat(F.lit("/x/"), "container").alias("path")).alias("file"))).alias("log"),
    )
    path = scratch_path(spark, "shipped")
    rows.write.json(path)
    return path


LEVEL_OF = """CASE WHEN event_id % 4 = 0 THEN 'ERROR' WHEN contains(message, 'error') THEN 'ERROR' ELSE 'INFO' END"""


@register(
    "ingest_logs",
    with_(LOGS_SQL) + f"""SELECT "timestamp", container, 'unknown' AS service, {LEVEL_OF} AS level, message FROM logs""",
)
def ingest_logs(spark, d):
    stream = S.file_json_stream(spark, shipped(spark, d), S.SHIPPER_SCHEMA)
    stored = run_once(L.shape_logs(stream), spark, "ingested")
    return stored.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).drop("raw")


# Fixed containers stand for the eight services, so that ids lead to names and names to services.
NAMES = sorted(C.CONTAINER_SERVICE)[:8]


def by_number(values: list[str]) -> str:
    return "CASE service " + " ".join(f"WHEN 'svc{i}' THEN '{v}'" for i, v in enumerate(values)) + " END"


@register(
    "ingest_logs_by_id",
    with_(LOGS_SQL)
    + f"""SELECT "timestamp", {by_number(NAMES)} AS container, {by_number([C.CONTAINER_SERVICE[n] for n in NAMES])} AS service,
  CASE WHEN contains(message, 'error') THEN 'ERROR' ELSE 'INFO' END AS level, message FROM logs""",
)
def ingest_logs_by_id(spark, d):
    """Messages that only name their container's id, in the path of its log; a table of names tells which it is."""
    logs = D.logs(spark, d)
    container = F.concat(F.md5("service"), F.md5("service"))
    rows = logs.select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        "message",
        F.struct(F.struct(F.concat(F.lit("/var/lib/docker/containers/"), container, F.lit("/"), container, F.lit("-json.log")).alias("path")).alias("file")).alias("log"),
    )
    path = scratch_path(spark, "shipped")
    rows.write.json(path)
    known = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.substring("service", 4, 1).cast("int") + 1)
    names = logs.select("service").distinct().select(container.alias("container_id"), known.alias("name"))
    stored = run_once(L.shape_logs(S.file_json_stream(spark, path, S.SHIPPER_SCHEMA), names), spark, "named")
    return stored.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).drop("raw")


@register("ingest_metrics", with_(METRICS_SQL) + 'SELECT "timestamp", container, service, cpu_percent, memory_percent, memory_usage, memory_limit FROM metrics')
def ingest_metrics(spark, d):
    """Published as JSON values, decoded from the stream, stored as they are."""
    path = scratch_path(spark, "published")
    S.to_messages(D.metrics(spark, d).drop("event_id")).write.text(path)
    stored = run_once(S.file_json_stream(spark, path, S.METRIC_SCHEMA).drop("raw"), spark, "metrics")
    return stored.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("flush_by_count", with_(LOGS_SQL) + "SELECT container, count(*) AS stored, TRUE AS in_bounds FROM logs GROUP BY 1")
def flush_by_count(spark, d):
    """Batches flushed in files of at most fifty documents."""
    out, state = scratch_path(spark, "flushed"), scratch_path(spark, "flushed-state")
    feed = log_stream(spark, d).filter("event_id >= 0")
    S.micro_batch_sink(feed, S.store_batches(out, documents=50), state).awaitTermination()
    stored = spark.read.schema(feed.schema).option("recursiveFileLookup", True).parquet(out)
    per_file = stored.groupBy(F.input_file_name().alias("file"), "container").agg(F.count("*").alias("n"))
    sized = per_file.withColumn("held", F.sum("n").over(Window.partitionBy("file")))
    return sized.groupBy("container").agg(F.sum("n").alias("stored"), (F.max("held") <= 50).alias("in_bounds"))


DOC_ID = """concat_ws('_', container, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), substring(md5(message), 1, 8))"""


@register("dedupe_logs", with_(LOGS_SQL) + f"""SELECT {DOC_ID} AS doc_id FROM (SELECT DISTINCT container, "timestamp", message FROM logs)""")
def dedupe_logs(spark, d):
    """Every row twice in, once out (batch twin)."""
    logs = D.logs(spark, d)
    return L.dedupe_logs(logs.unionByName(logs)).select("doc_id")


@register("dedupe_logs_stream", with_(LOGS_SQL) + f"""SELECT {DOC_ID} AS doc_id FROM (SELECT DISTINCT container, "timestamp", message FROM logs)""")
def dedupe_logs_stream(spark, d):
    twice = log_stream(spark, d).filter("event_id >= 0").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_once(L.dedupe_logs(twice), spark, "deduped").select("doc_id")


TUMBLING_SQL = f"""SELECT date_trunc('hour', "timestamp") AS bucket, {SUMS} FROM logs GROUP BY 1"""


@register("tumbling_trend", with_(LOGS_SQL) + TUMBLING_SQL)
def tumbling_trend(spark, d):
    trend = L.tumbling_trend(D.logs(spark, d))
    return trend.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("tumbling_trend_stream", with_(LOGS_SQL) + TUMBLING_SQL)
def tumbling_trend_stream(spark, d):
    stored = run_once(L.tumbling_trend(log_stream(spark, d)), spark, "trend")
    return stored.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register(
    "sliding_errors_batch",
    with_(LOGS_SQL)
    + """SELECT s AS start, s + INTERVAL 2 HOUR AS "end", service, count(*) AS errors
FROM logs, (VALUES (0), (1)) w(i), LATERAL (SELECT date_trunc('hour', "timestamp") - to_hours(i) AS s)
WHERE level IN ('ERROR', 'CRITICAL') GROUP BY 1, 2, 3""",
)
def sliding_errors_batch(spark, d):
    out = L.sliding_errors(D.logs(spark, d), 7200, 3600)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register(
    "late_rows",
    with_(LOGS_SQL) + """SELECT count(*) FILTER (WHERE "timestamp" < TIMESTAMP '2024-01-10 00:00:00') AS late_rows FROM logs""",
)
def late_rows(spark, d):
    horizon = F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz")
    return L.split_late(D.logs(spark, d), horizon)[1]


@register(
    "late_rows_stream",
    with_(LOGS_SQL)
    + """SELECT count(*) FILTER (WHERE "timestamp" < TIMESTAMP '2024-01-16 00:00:00') AS late_rows, count(DISTINCT (container, "timestamp", message)) FILTER (WHERE "timestamp" >= TIMESTAMP '2024-01-16 00:00:00') AS kept FROM logs""",
)
def late_rows_stream(spark, d):
    """The second half of the month comes first, in two batches; what the stream then drops behind its watermark, it counts."""
    path, out = scratch_path(spark, "late"), scratch_path(spark, "kept")
    logs = D.logs(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    early = F.col("timestamp") < F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz").cast("timestamp")
    half = F.pmod("event_id", F.lit(2)) == 0
    for lot in (~early & half, ~early & ~half, early):
        logs.filter(lot).repartition(4, "event_id").write.mode("append").parquet(path)
    feed = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 4).parquet(path)
    query = S.micro_batch_sink(L.dedupe_logs(feed), S.store_batches(out), scratch_path(spark, "kept-state"))
    query.awaitTermination()
    kept = spark.read.schema(L.with_doc_id(logs).schema).option("recursiveFileLookup", True).parquet(out)
    return kept.agg(F.count("*").alias("kept")).select(F.lit(S.dropped_late(query)).cast("long").alias("late_rows"), "kept")


def naive(stored):
    return stored.withColumn("at", F.col("at").cast("timestamp_ntz"))


@register(
    "critical_alert_stream",
    with_(LOGS_SQL, """keyed AS (SELECT DISTINCT message[1:100] AS message, date_trunc('second', "timestamp") AS moment FROM logs WHERE level IN ('ERROR', 'CRITICAL'))""")
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .rstrip()
    + f""",
fires AS (SELECT message, min(moment) AS moment FROM keyed GROUP BY 1
  UNION ALL SELECT f.message, min(k.moment) FROM fires f JOIN keyed k ON k.message = f.message AND k.moment >= f.moment + INTERVAL 6 HOUR GROUP BY f.message, f.moment)
SELECT message, moment AS "at" FROM fires""",
)
def critical_alert_stream(spark, d):
    return naive(run_once(A.critical_alert_stream(log_stream(spark, d), 6 * 3600), spark, "critical"))


@register("recovery_stream", DECIDED_SQL)
def recovery_stream(spark, d):
    return naive(run_once(A.recovery_stream(log_stream(spark, d), **RECOVERY, restartable=RESTARTABLE), spark, "recovery"))


@register(
    "sliding_error_count_stream",
    with_(LOGS_SQL, """errors AS (SELECT service, date_trunc('second', "timestamp") AS moment FROM logs WHERE level IN ('ERROR', 'CRITICAL'))""")
    + """SELECT DISTINCT service, moment AS "at", count(*) OVER (PARTITION BY service ORDER BY moment RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) AS in_window
FROM errors""",
)
def sliding_error_count_stream(spark, d):
    return naive(run_once(A.sliding_count_stream(log_stream(spark, d), window_s=7200), spark, "sliding"))


@register("rate_limit_stream", ORACLES["rate_limit_by_service"])
def rate_limit_stream(spark, d):
    return naive(run_once(A.rate_limit_stream(log_stream(spark, d), condition=F.col("level") == "ERROR", **RATE), spark, "limited"))
