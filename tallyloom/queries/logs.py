"""Log and metric analytics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions import logs as L
from tallyloom.operators import aggregates as A
from tallyloom.operators import alerts as AL
from tallyloom.operators import ranking as R
from tallyloom.operators import windows as W
from tallyloom.plans import domain as D
from tallyloom.plans.domain import LOGS_SQL, METRICS_SQL, PRODUCTS_SQL, with_
from tallyloom.queries import register
from tallyloom.sources import exports as E
from tallyloom.sources.files import split_tail_line

AS_OF = dt.datetime(2024, 1, 31)
MONTH_HOURS = 24 * 31  # a lookback that takes the whole table in
ERRORS = "level IN ('ERROR', 'CRITICAL')"
SUMS = f"""CAST(count(*) FILTER (WHERE {ERRORS}) AS BIGINT) AS errors, count(*) FILTER (WHERE level = 'WARN') AS warns, count(*) FILTER (WHERE level = 'INFO') AS infos"""


@register("count_by_level", with_(LOGS_SQL) + "SELECT level, count(*) AS rows FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def count_by_level(spark, d):
    return A.count_by(D.logs(spark, d), "level", 10)


@register("count_by_service", with_(LOGS_SQL) + "SELECT service, count(*) AS rows FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def count_by_service(spark, d):
    return A.count_by(D.logs(spark, d), "service", 20)


TREND_SQL = f"""counts AS (SELECT date_trunc('hour', "timestamp") AS bucket, {SUMS} FROM logs GROUP BY 1),
hours AS (SELECT unnest(generate_series((SELECT min(bucket) FROM counts), (SELECT max(bucket) FROM counts), INTERVAL 1 HOUR)) AS bucket),
trend AS (SELECT hours.bucket, coalesce(errors, 0) AS errors, coalesce(warns, 0) AS warns, coalesce(infos, 0) AS infos FROM hours LEFT JOIN counts ON hours.bucket = counts.bucket)"""


@register("log_trend", with_(LOGS_SQL, TREND_SQL) + "SELECT * FROM trend")
def log_trend(spark, d):
    return A.log_trend(D.logs(spark, d))


SPARSE_SQL = LOGS_SQL.replace("FROM events)", "FROM events WHERE value > 60)")


@register("log_trend_with_gaps", with_(SPARSE_SQL, TREND_SQL) + "SELECT * FROM trend")
def log_trend_with_gaps(spark, d):
    """Only the costly events, so that hours are missing."""
    dear = D.table(spark, d, "events").filter(F.col("value") > 60).select("event_id")
    return A.log_trend(D.logs(spark, d).join(dear, "event_id", "left_semi"))


TOP_ERRORS_SQL = f"""errors AS (SELECT * FROM logs WHERE {ERRORS} AND length(message) <= 256),
best AS (SELECT message, count(*) AS "count", max("timestamp") AS last_seen, arg_max(container, event_id) AS container
  FROM errors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
cells AS (SELECT message, service, count(*) AS c FROM errors GROUP BY 1, 2),
tops AS (SELECT message, string_agg(service, ',' ORDER BY c DESC, service) AS services FROM (
  SELECT *, row_number() OVER (PARTITION BY message ORDER BY c DESC, service) AS r FROM cells) WHERE r <= 5 GROUP BY 1)"""


@register("top_errors", with_(LOGS_SQL, TOP_ERRORS_SQL) + 'SELECT message, "count", services, last_seen, container FROM best JOIN tops USING (message)')
def top_errors(spark, d):
    return A.top_errors(D.logs(spark, d), longest=256).withColumn("services", F.array_join("services", ","))


HEALTH_SQL = f"""health AS (SELECT *, CASE WHEN total > 0 THEN round(errors::DOUBLE / total * 100, 2) ELSE 0 END AS error_rate FROM (
  SELECT service, count(*) AS total, count(*) FILTER (WHERE {ERRORS}) AS errors, count(*) FILTER (WHERE level = 'WARN') AS warns FROM logs GROUP BY 1))"""


@register(
    "service_health",
    with_(LOGS_SQL, HEALTH_SQL)
    + "SELECT *, CASE WHEN error_rate > 10 OR errors > 20 THEN 'critical' WHEN error_rate > 3 OR warns > 10 THEN 'warning' ELSE 'healthy' END AS status FROM health",
)
def service_health(spark, d):
    return A.service_health(D.logs(spark, d))


@register(
    "service_health_by_user",
    with_(LOGS_SQL.replace("user_id % 8", "user_id"), HEALTH_SQL)
    + "SELECT *, CASE WHEN error_rate > 10 OR errors > 20 THEN 'critical' WHEN error_rate > 3 OR warns > 10 THEN 'warning' ELSE 'healthy' END AS status FROM health",
)
def service_health_by_user(spark, d):
    """Many small services, so that totals differ."""
    owner = D.table(spark, d, "events").select("event_id", F.concat(F.lit("svc"), F.col("user_id").cast("string")).alias("service"))
    return A.service_health(D.logs(spark, d).drop("service").join(owner, "event_id"))


RECENT_HOURS = 240


@register(
    "dashboard",
    with_(
        LOGS_SQL.replace("logs AS", "all_logs AS", 1),
        f"""logs AS (SELECT * FROM all_logs WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {MONTH_HOURS} HOUR)""",
        f"""recent AS (SELECT * FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {RECENT_HOURS} HOUR)""",
        TREND_SQL,
        HEALTH_SQL.replace("FROM logs", "FROM recent"),
        TOP_ERRORS_SQL,
    )
    + """SELECT 'by_level' AS section, level AS key, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value, NULL::VARCHAR AS text FROM recent GROUP BY level
UNION ALL SELECT 'by_service', service, 'rows', CAST(count(*) AS DOUBLE), NULL FROM recent GROUP BY service
UNION ALL SELECT 'trend', strftime(bucket, '%Y-%m-%d %H:%M'), m, CAST(v AS DOUBLE), NULL FROM (UNPIVOT trend ON errors, warns, infos INTO NAME m VALUE v)
UNION ALL SELECT 'health', service, m, v, NULL FROM (UNPIVOT (SELECT service, total::DOUBLE AS total, errors::DOUBLE AS errors, warns::DOUBLE AS warns, error_rate::DOUBLE AS error_rate FROM health) ON total, errors, warns, error_rate INTO NAME m VALUE v)
UNION ALL SELECT 'health', service, 'status', NULL, CASE WHEN error_rate > 10 OR errors > 20 THEN 'critical' WHEN error_rate > 3 OR warns > 10 THEN 'warning' ELSE 'healthy' END FROM health
UNION ALL SELECT 'top_errors', message, 'count', CAST("count" AS DOUBLE), NULL FROM best
UNION ALL SELECT 'top_errors', message, 'services', NULL, services FROM best JOIN tops USING (message)
UNION ALL SELECT 'top_errors', message, 'last_seen', NULL, strftime(last_seen, '%Y-%m-%d %H:%M:%S') FROM best
UNION ALL SELECT 'top_errors', message, 'container', NULL, container FROM best""",
)
def dashboard(spark, d):
    """Ten days of health beside a month's trend and top errors."""
    return A.dashboard(D.logs(spark, d), AS_OF, hours=MONTH_HOURS, recent_hours=RECENT_HOURS, longest=256)


STATS_SQL = """stats AS (SELECT service, round(avg(cpu_percent), 2) AS avg_cpu, round(avg(memory_percent), 2) AS avg_mem,
  round(max(memory_usage)::DOUBLE / 1024 / 1024, 2) AS max_mem_mb FROM metrics GROUP BY 1)"""


@register("metric_stats", with_(METRICS_SQL, STATS_SQL) + "SELECT * FROM stats")
def metric_stats(spark, d):
    return A.metric_stats(D.metrics(spark, d))


LATEST_SQL = """latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY "timestamp" DESC, event_id DESC) AS r FROM metrics) WHERE r = 1)"""


@register("latest_per_container", with_(METRICS_SQL, LATEST_SQL) + "SELECT * FROM latest")
def latest_per_container(spark, d):
    return R.latest_per(D.metrics(spark, d), ["container"], "timestamp", "event_id")


@register(
    "metric_stats_snapshot",
    with_(METRICS_SQL, LATEST_SQL)
    + "SELECT service, round(avg(cpu_percent), 6) AS avg_cpu, round(avg(memory_percent), 6) AS avg_mem, round(max(memory_usage)::DOUBLE / 1024 / 1024, 6) AS max_mem_mb FROM latest GROUP BY 1",
)
def metric_stats_snapshot(spark, d):
    snapshot = R.latest_per(D.metrics(spark, d), ["container"], "timestamp", "event_id")
    stats = A.metric_stats(snapshot, digits=None)
    return stats.select("service", *[F.round(c, 6).alias(c) for c in ("avg_cpu", "avg_mem", "max_mem_mb")])


@register(
    "fleet_kpis",
    with_(METRICS_SQL, STATS_SQL)
    + """SELECT round(avg(avg_cpu), 1) AS fleet_cpu, round(avg(avg_mem), 1) AS fleet_mem, round(max(max_mem_mb), 0) AS top_mem_mb,
  (SELECT service FROM stats ORDER BY max_mem_mb DESC, service LIMIT 1) AS top_mem_service, round(max(avg_cpu), 1) AS top_cpu,
  (SELECT service FROM stats ORDER BY avg_cpu DESC, service LIMIT 1) AS top_cpu_service FROM stats""",
)
def fleet_kpis(spark, d):
    return A.fleet_kpis(A.metric_stats(D.metrics(spark, d)))


@register(
    "error_spike_banner",
    with_(LOGS_SQL, TREND_SQL)
    + """SELECT count(*) AS buckets, CAST(arg_max(errors, bucket) AS BIGINT) AS last_errors,
  round((sum(errors) - arg_max(errors, bucket))::DOUBLE / (count(*) - 1), 6) AS mean_before,
  count(*) >= 3 AND arg_max(errors, bucket) > 5 AND arg_max(errors, bucket) > 3 * (sum(errors) - arg_max(errors, bucket))::DOUBLE / (count(*) - 1) AS spike FROM trend""",
)
def error_spike_banner(spark, d):
    return A.error_spike_banner(A.log_trend(D.logs(spark, d)))


@register("counts_by_day", with_(PRODUCTS_SQL) + 'SELECT CAST(create_dt AS DATE) AS "day", count(*) AS rows FROM products GROUP BY 1 ORDER BY 1 DESC LIMIT 5')
def counts_by_day(spark, d):
    return A.counts_by_day(D.products(spark, d), "create_dt")


@register(
    "spike_summary",
    with_(
        LOGS_SQL,
        "errors AS (SELECT service, CASE WHEN length(m) > 80 THEN m[1:80] || '...' ELSE m END AS short, \"timestamp\", event_id FROM (SELECT *, message || repeat(' detail', 15 - event_id % 10) AS m FROM logs WHERE level IN ('ERROR', 'CRITICAL')))",
    )
    + """SELECT 'service' AS section, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank, service AS text, n AS rows
FROM (SELECT service, count(*) AS n, min(("timestamp", event_id)) AS f FROM errors GROUP BY 1)
UNION ALL SELECT 'message', CAST(row_number() OVER (ORDER BY f) AS INTEGER), short, NULL FROM (
  SELECT short, min(("timestamp", event_id)) AS f FROM errors GROUP BY 1 ORDER BY f LIMIT 3)""",
)
def spike_summary(spark, d):
    errors = D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL"))
    longer = errors.withColumn("message", F.concat("message", F.repeat(F.lit(" detail"), (15 - F.col("event_id") % 10).cast("int"))))
    return A.spike_summary(longer)


@register("throughput_per_min", with_(LOGS_SQL) + "SELECT count(*) / 60.0::DOUBLE AS per_minute FROM logs")
def throughput_per_min(spark, d):
    return A.throughput_per_min(D.logs(spark, d))


@register(
    "load_summary",
    "SELECT user_id % 10 AS batch, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1",
)
def load_summary(spark, d):
    rows = D.table(spark, d, "events").withColumn("batch", F.col("user_id") % 10)
    return A.load_summary(rows, F.col("event_type") == "error", "batch")


KNOWN = [f"svc{i}" for i in range(8)]


@register(
    "pivot_series",
    with_(METRICS_SQL)
    + 'SELECT "minute", '
    + ", ".join(f"arg_max(cpu_percent, event_id) FILTER (WHERE service = '{s}') AS {s}" for s in KNOWN)
    + " FROM (SELECT *, date_trunc('minute', \"timestamp\") AS \"minute\" FROM metrics) GROUP BY 1",
)
def pivot_series(spark, d):
    rows = D.metrics(spark, d).withColumn("minute", F.date_trunc("MINUTE", "timestamp").cast("timestamp_ntz"))
    return A.pivot_series(rows, "minute", "service", KNOWN, "cpu_percent", "event_id")


@register("newest_logs", with_(LOGS_SQL) + 'SELECT event_id, "timestamp", level, message FROM logs ORDER BY "timestamp" DESC, event_id DESC LIMIT 100')
def newest_logs(spark, d):
    return R.newest(D.logs(spark, d), "timestamp", 100, "event_id").select("event_id", "timestamp", "level", "message")


@register(
    "latest_hit",
    with_(LOGS_SQL) + 'SELECT message, max("timestamp") AS last_seen, arg_max(container, event_id) AS container FROM logs GROUP BY 1',
)
def latest_hit(spark, d):
    rows = D.logs(spark, d).select("message", "timestamp", "container", "event_id")
    return R.latest_per(rows, ["message"], "timestamp", "event_id").select(
        "message", F.col("timestamp").alias("last_seen"), "container"
    )


@register(
    "sliding_error_count",
    with_(LOGS_SQL)
    + f"""SELECT DISTINCT service, "timestamp", count(*) OVER (PARTITION BY service ORDER BY "timestamp" RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) AS in_window
FROM logs WHERE {ERRORS}""",
)
def sliding_error_count(spark, d):
    errors = D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL"))
    return W.sliding_count(errors, ["service"], "timestamp", 7200)


@register(
    "sliding_error_count_global",
    with_(LOGS_SQL)
    + f"""SELECT DISTINCT "timestamp", count(*) OVER (ORDER BY "timestamp" RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS in_window
FROM logs WHERE {ERRORS}""",
)
def sliding_error_count_global(spark, d):
    errors = D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL"))
    return W.sliding_count(errors, [], "timestamp", 3600)


COUNTERS_SQL = """counters AS (SELECT event_id, user_id, ts, event_id * 1000 + CAST(floor(value * 100) AS BIGINT) AS used, event_id * 9000 + user_id AS sys FROM events)"""


@register(
    "counter_delta",
    with_(
        COUNTERS_SQL,
        "t AS (SELECT *, lag(used) OVER w AS p_used, lag(sys) OVER w AS p_sys FROM counters WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
    )
    + """SELECT event_id, user_id, used - p_used AS used_delta, sys - p_sys AS sys_delta,
  round(CASE WHEN sys - p_sys > 0 AND p_sys > 0 AND used - p_used > 0 THEN (used - p_used)::DOUBLE / (sys - p_sys) * 100 ELSE 0 END, 4) AS cpu_percent FROM t""",
)
def counter_delta(spark, d):
    counters = D.table(spark, d, "events").select(
        "event_id",
        "user_id",
        "ts",
        (F.col("event_id") * 1000 + F.floor(F.col("value") * 100).cast("long")).alias("used"),
        (F.col("event_id") * 9000 + F.col("user_id")).alias("sys"),
    )
    lagged = W.chunked_lag(counters, ["user_id"], ["ts", "event_id"], ["used", "sys"])
    share = L.cpu_percent(F.col("used"), F.col("prev_used"), F.col("sys"), F.col("prev_sys"))
    return lagged.select(
        "event_id",
        "user_id",
        (F.col("used") - F.col("prev_used")).alias("used_delta"),
        (F.col("sys") - F.col("prev_sys")).alias("sys_delta"),
        F.round(share, 4).alias("cpu_percent"),
    )


@register(
    "window_status",
    with_(LOGS_SQL)
    + f"""SELECT service, count(*) AS in_window FROM logs WHERE {ERRORS} AND "timestamp" > TIMESTAMP '2024-01-29 20:00:00' AND "timestamp" <= TIMESTAMP '2024-01-30 20:00:00' GROUP BY 1""",
)
def window_status(spark, d):
    return A.window_status(D.logs(spark, d), dt.datetime(2024, 1, 30, 20), 24 * 3600)


@register(
    "export_log_lines",
    with_(LOGS_SQL)
    + r"""SELECT '[' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '] [' || level || '] [' || service || '] ' || container || ' - ' ||
  replace(CASE WHEN event_id % 3 = 0 THEN message || E'\nmore' ELSE message END, E'\n', '  ') AS line
FROM logs WHERE level = 'WARN' ORDER BY "timestamp" DESC, event_id DESC LIMIT 10000""",
)
def export_log_lines(spark, d):
    message = F.when(F.col("event_id") % 3 == 0, F.concat("message", F.lit("\nmore"))).otherwise(F.col("message"))
    return E.log_text(D.logs(spark, d).withColumn("message", message), level="WARN", service="ALL", size=10_000)


@register(
    "tail_lines",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'now' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS "timestamp",
  CASE event_id % 3 WHEN 2 THEN event_type ELSE event_type || ' and more' END AS message FROM events""",
)
def tail_lines(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(stamp, F.lit("123Z "), "event_type", F.lit(" and more")))
        .when(F.col("event_id") % 3 == 1, F.concat(stamp, F.lit(" "), "event_type", F.lit(" and more")))
        .otherwise(F.col("event_type"))
    )
    return D.table(spark, d, "events").select("event_id", split_tail_line(line, F.lit("now")).alias("r")).select("event_id", "r.*")


@register(
    "startup_grace",
    with_(LOGS_SQL) + """SELECT event_id, level FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-15 00:05:00'""",
)
def startup_grace(spark, d):
    return AL.after_grace(D.logs(spark, d), dt.datetime(2024, 1, 15)).select("event_id", "level")
