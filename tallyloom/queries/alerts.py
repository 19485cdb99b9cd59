"""Alert and recovery decisions (batch twins of the alert streams)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.operators import alerts as AL
from tallyloom.operators import windows as W
from tallyloom.plans import domain as D
from tallyloom.plans.domain import LOGS_SQL, with_
from tallyloom.queries import register

# The events are sparse, so windows are hours here, not minutes.
SPIKE = dict(window_s=6 * 3600, threshold=40, cooldown_s=3 * 3600)
CRITICAL_COOLDOWN = 6 * 3600
RECOVERY = dict(window_s=6 * 3600, threshold=8, cooldown_s=4 * 3600, per_hour=1)
RESTARTABLE = ("svc0", "svc1", "svc2", "svc5", "svc7")
RATE = dict(window_s=4 * 3600, max_sent=3, open_s=8 * 3600)

TRACKED_SQL = """tracked AS (SELECT date_trunc('second', "timestamp") AS moment FROM logs WHERE level IN ('ERROR', 'CRITICAL') AND service NOT IN ('svc3'))"""
CANDIDATES_SQL = f"""counted AS (SELECT DISTINCT moment, count(*) OVER (ORDER BY moment RANGE BETWEEN INTERVAL {SPIKE['window_s']} SECOND PRECEDING AND CURRENT ROW) AS errors FROM tracked),
candidates AS (SELECT * FROM counted WHERE errors >= {SPIKE['threshold']})"""


def tracked(spark, d):
    return AL.tracked_errors(D.logs(spark, d), "ERROR", excluded=["svc3"])


@register("spike_candidates", with_(LOGS_SQL, TRACKED_SQL, CANDIDATES_SQL) + 'SELECT moment AS "timestamp", errors FROM candidates')
def spike_candidates(spark, d):
    return AL.spike_candidates(tracked(spark, d), SPIKE["window_s"], SPIKE["threshold"])


@register(
    "spike_alerts",
    with_(LOGS_SQL, TRACKED_SQL, CANDIDATES_SQL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
fires AS (SELECT min(moment) AS moment FROM candidates
  UNION ALL SELECT (SELECT min(c.moment) FROM candidates c WHERE c.moment >= f.moment + INTERVAL {SPIKE['cooldown_s']} SECOND) FROM fires f WHERE f.moment IS NOT NULL)
SELECT f.moment AS "timestamp", errors FROM fires f JOIN candidates USING (moment)""",
)
def spike_alerts(spark, d):
    return AL.spike_alerts(tracked(spark, d), **SPIKE)


STARTED, GRACE = dt.datetime(2024, 1, 10), 2 * 24 * 3600


@register(
    "spike_alerts_after_grace",
    with_(LOGS_SQL, TRACKED_SQL, CANDIDATES_SQL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
open AS (SELECT * FROM candidates WHERE moment >= TIMESTAMP '{STARTED}' + INTERVAL {GRACE} SECOND),
fires AS (SELECT min(moment) AS moment FROM open
  UNION ALL SELECT (SELECT min(c.moment) FROM open c WHERE c.moment >= f.moment + INTERVAL {SPIKE['cooldown_s']} SECOND) FROM fires f WHERE f.moment IS NOT NULL)
SELECT f.moment AS "timestamp", errors FROM fires f JOIN open USING (moment)""",
)
def spike_alerts_after_grace(spark, d):
    """Errors of the grace count in the windows that follow it."""
    return AL.spike_alerts(tracked(spark, d), **SPIKE, started_at=STARTED, grace_s=GRACE)


KEYED_SQL = """keyed AS (SELECT DISTINCT message[1:100] AS message, "timestamp" AS moment FROM logs WHERE level IN ('ERROR', 'CRITICAL'))"""
FIRES_SQL = f"""fires AS (SELECT message, min(moment) AS moment FROM keyed GROUP BY 1
  UNION ALL SELECT f.message, min(k.moment) FROM fires f JOIN keyed k ON k.message = f.message AND k.moment >= f.moment + INTERVAL {CRITICAL_COOLDOWN} SECOND GROUP BY f.message, f.moment)"""


@register("critical_alerts", with_(LOGS_SQL, KEYED_SQL, FIRES_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + 'SELECT message, moment AS "timestamp" FROM fires')
def critical_alerts(spark, d):
    return AL.critical_alerts(D.logs(spark, d), CRITICAL_COOLDOWN, min_level="ERROR")


@register(
    "error_sessions",
    with_(
        LOGS_SQL,
        "errors AS (SELECT DISTINCT service, \"timestamp\" FROM logs WHERE level IN ('ERROR', 'CRITICAL'))",
        """marked AS (SELECT *, lag("timestamp") OVER (PARTITION BY service ORDER BY "timestamp") AS prev FROM errors)""",
        """numbered AS (SELECT *, max(CASE WHEN prev IS NULL OR "timestamp" - prev >= INTERVAL 3600 SECOND THEN epoch_us("timestamp") END) OVER (PARTITION BY service ORDER BY "timestamp") AS session FROM marked)""",
    )
    + "SELECT service, session, count(*) AS rows FROM numbered GROUP BY 1, 2",
)
def error_sessions(spark, d):
    errors = D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL")).select("service", "timestamp").distinct()
    return W.sessions(errors, ["service"], "timestamp", 3600).groupBy("service", "session").agg(F.count("*").alias("rows"))


# The limiter, one second at a time and all keys side by side: the state travels in lists.
def limiter_sql(attempts: str) -> str:
    """CTEs ``seconds`` and ``walk`` over ``attempts``, a query with columns (service, moment)."""
    return f"""seconds AS (SELECT service, moment, epoch(moment)::BIGINT AS s, count(*) AS n, row_number() OVER (PARTITION BY service ORDER BY moment) AS i
  FROM ({attempts}) GROUP BY 1, 2, 3),
walk AS (
  SELECT service, 0::BIGINT AS i, NULL::TIMESTAMP AS moment, []::BIGINT[] AS sent_at, NULL::BIGINT AS opened, 0::BIGINT AS sent, 0::BIGINT AS rate_limited, 0::BIGINT AS circuit_open
  FROM (SELECT DISTINCT service FROM seconds)
  UNION ALL
  SELECT service, i, moment, CASE WHEN is_open THEN sent_at ELSE list_concat(live, list_transform(range(granted), lambda x: s)) END,
    CASE WHEN is_open THEN opened WHEN n > granted THEN s END, granted, CASE WHEN NOT is_open AND n > granted THEN 1 ELSE 0 END,
    CASE WHEN is_open THEN n WHEN n > granted THEN n - granted - 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN is_open THEN 0 ELSE least(n, {RATE['max_sent']} - len(live)) END::BIGINT AS granted FROM (
    SELECT c.service, c.i, c.moment, c.s, c.n, w.sent_at, w.opened, coalesce(c.s - w.opened < {RATE['open_s']}, FALSE) AS is_open,
      list_filter(w.sent_at, lambda x: c.s - x <= {RATE['window_s']}) AS live
    FROM walk w JOIN seconds c ON c.service = w.service AND c.i = w.i + 1)))
"""


def recursive(*views: str) -> str:
    return with_(*views).replace("WITH ", "WITH RECURSIVE ", 1)


BY_SERVICE = """SELECT service, date_trunc('second', "timestamp") AS moment FROM logs WHERE level = 'ERROR'"""


@register(
    "rate_limit_by_service",
    recursive(LOGS_SQL, limiter_sql(BY_SERVICE)) + 'SELECT service, moment AS "at", sent, rate_limited, circuit_open FROM walk WHERE i > 0',
)
def rate_limit_by_service(spark, d):
    errors = D.logs(spark, d).filter(F.col("level") == "ERROR")
    return AL.rate_limit(errors, ["service"], **RATE)


STATUS_AT = dt.datetime(2024, 1, 20, 12)


@register(
    "alert_status",
    recursive(
        LOGS_SQL,
        limiter_sql(BY_SERVICE),
        f"""within_ AS (SELECT service, count(*) AS in_window FROM logs WHERE level IN ('ERROR', 'CRITICAL') AND "timestamp" BETWEEN TIMESTAMP '{STATUS_AT}' - INTERVAL 12 HOUR AND TIMESTAMP '{STATUS_AT}' GROUP BY 1)""",
        f"""out_ AS (SELECT service, coalesce(sum(sent) FILTER (moment >= TIMESTAMP '{STATUS_AT}' - INTERVAL 12 HOUR), 0)::BIGINT AS sent_in_window,
  floor((epoch_us(TIMESTAMP '{STATUS_AT}') - epoch_us(max(moment))) / 1000000)::BIGINT AS last_sent_ago FROM walk WHERE i > 0 AND sent > 0 AND moment <= TIMESTAMP '{STATUS_AT}' GROUP BY 1)""",
        f"""up_ AS (SELECT service, (epoch_us(TIMESTAMP '{STATUS_AT}') - epoch_us(max("timestamp"))) / 1000000 AS up FROM logs WHERE level = 'CRITICAL' AND "timestamp" <= TIMESTAMP '{STATUS_AT}' GROUP BY 1)""",
    )
    + """SELECT service, coalesce(in_window, 0) AS in_window, coalesce(sent_in_window, 0) AS sent_in_window, greatest(0, 4 - coalesce(sent_in_window, 0))::BIGINT AS may_send,
  last_sent_ago, ceil(greatest(0, 36000 - coalesce(up, 36000)))::BIGINT AS grace_remaining
FROM within_ FULL OUTER JOIN out_ USING (service) FULL OUTER JOIN up_ USING (service)""",
)
def alert_status(spark, d):
    """Errors, alerts sent by the limiter and the grace after the last start, at one moment; critical lines stand for starts."""
    logs = D.logs(spark, d)
    errors = logs.filter(F.col("level").isin("ERROR", "CRITICAL"))
    sent = AL.rate_limit(logs.filter(F.col("level") == "ERROR"), ["service"], **RATE)
    starts = logs.filter(F.col("level") == "CRITICAL")
    return AL.alert_status(errors, sent, starts, STATUS_AT, 12 * 3600, 12 * 3600, 4, 10 * 3600)


RECOVERY_SQL = f"""seconds AS (SELECT service, date_trunc('second', "timestamp") AS moment, epoch(date_trunc('second', "timestamp"))::BIGINT AS s, count(*) AS n,
    row_number() OVER (PARTITION BY service ORDER BY date_trunc('second', "timestamp")) AS i FROM logs WHERE level IN ('ERROR', 'CRITICAL') AND service IN ({', '.join(map(repr, RESTARTABLE))}) GROUP BY 1, 2, 3),
walk AS (
  SELECT service, 0::BIGINT AS i, NULL::TIMESTAMP AS moment, []::STRUCT(t BIGINT, c BIGINT)[] AS held, []::BIGINT[] AS restarts, NULL::VARCHAR AS action, 0::BIGINT AS errors
  FROM (SELECT DISTINCT service FROM seconds)
  UNION ALL
  SELECT service, i, moment,
    CASE WHEN act AND len(recent) < {RECOVERY['per_hour']} THEN [{{'t': s, 'c': before + n - due}}] ELSE list_append(live, {{'t': s, 'c': n}}) END,
    CASE WHEN NOT act THEN restarts WHEN len(recent) < {RECOVERY['per_hour']} THEN list_append(recent, s) ELSE recent END,
    CASE WHEN act THEN CASE WHEN len(recent) < {RECOVERY['per_hour']} THEN 'restart' ELSE 'restart_limit' END END, due
  FROM (SELECT *, before + n >= due AND (len(restarts) = 0 OR s - restarts[-1] >= {RECOVERY['cooldown_s']}) AS act, list_filter(restarts, lambda r: r > s - 3600) AS recent
    FROM (SELECT *, greatest({RECOVERY['threshold']}, before + 1) AS due FROM (SELECT *, coalesce(list_sum(list_transform(live, lambda x: x.c)), 0)::BIGINT AS before
      FROM (SELECT c.service, c.i, c.moment, c.s, c.n, w.restarts, list_filter(w.held, lambda x: c.s - x.t <= {RECOVERY['window_s']}) AS live
        FROM walk w JOIN seconds c ON c.service = w.service AND c.i = w.i + 1)))))
"""
DECIDED_SQL = recursive(LOGS_SQL, RECOVERY_SQL) + 'SELECT service, moment AS "at", action, errors FROM walk WHERE action IS NOT NULL'


@register("recovery_decisions", DECIDED_SQL)
def recovery_decisions(spark, d):
    return AL.recovery_decisions(D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL")), **RECOVERY, restartable=RESTARTABLE)


@register("last_actions", DECIDED_SQL + ' ORDER BY "at" DESC, service LIMIT 10')
def last_actions(spark, d):
    errors = D.logs(spark, d).filter(F.col("level").isin("ERROR", "CRITICAL"))
    return AL.last_actions(AL.recovery_decisions(errors, **RECOVERY, restartable=RESTARTABLE))
