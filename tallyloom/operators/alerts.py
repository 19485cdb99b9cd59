"""Alert and recovery decisions as rows, on event time.

Wall-clock deques become per-second counts: at most one row per key and
second, whatever the volume. Runs that are far enough apart to forget each
other are split into sessions, and only what has to be walked in order
(limiter and recovery state) is walked, one session at a time.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions.logs import in_active_hours, is_startup_noise, level_rank
from tallyloom.functions.predicates import alertable
from tallyloom.operators.windows import asof_join, cooldown_fires, sessions, sliding_count


def to_second(ts: str = "timestamp") -> Column:
    return F.date_trunc("SECOND", F.col(ts)).cast("timestamp_ntz")


def after_grace(df: DataFrame, started_at: dt.datetime, grace_s: int = C.STARTUP_GRACE_S, ts: str = "timestamp") -> DataFrame:
    """Nothing in the first ``grace_s`` seconds after a start counts."""
    return df.filter(F.col(ts) >= F.lit(started_at + dt.timedelta(seconds=grace_s)).cast("timestamp_ntz"))


def after_starts(
    df: DataFrame, starts: DataFrame, key: str = "service", grace_s: int = C.STARTUP_GRACE_S, ts: str = "timestamp"
) -> DataFrame:
    """Rows of a service that are not within ``grace_s`` of its last start; ``starts`` has (key, ts), any number a service."""
    begun = starts.select(key, ts, F.col(ts).alias("__started"))
    rows = asof_join(df, begun, [key], ts, ["__started"])
    open_ = F.col("__started").isNull() | (F.col(ts) >= F.col("__started") + F.make_dt_interval(secs=F.lit(grace_s)))
    return rows.filter(open_).drop("__started")


def counts_toward_spike(min_level: str = "CRITICAL", excluded: Sequence[str] = ()) -> Column:
    """Errors of a level high enough, of a service not excluded, that are no start-up noise."""
    counted = F.col("level").isin("ERROR", "CRITICAL") & (level_rank(F.col("level")) >= C.LEVEL_RANK.get(min_level, 0))
    if excluded:
        counted = counted & ~F.col("service").isin(list(excluded))
    return counted & ~is_startup_noise(F.col("message"))


def tracked_errors(df: DataFrame, min_level: str = "CRITICAL", excluded: Sequence[str] = ()) -> DataFrame:
    return df.filter(counts_toward_spike(min_level, excluded))


def spike_candidates(
    tracked: DataFrame,
    window_s: int = C.SPIKE_WINDOW_S,
    threshold: int = C.SPIKE_THRESHOLD,
    hours: tuple[int | None, int | None] = (None, None),
    started_at: dt.datetime | None = None,
    grace_s: int = C.STARTUP_GRACE_S,
) -> DataFrame:
    """Seconds at which the window holds ``threshold`` errors or more and an alert may go out.

    Errors of the first ``grace_s`` seconds after ``started_at`` count in the
    window; only alerts are held back.
    """
    seconds = tracked.select(to_second().alias("timestamp"))
    counts = sliding_count(seconds, [], "timestamp", window_s, "errors")
    found = counts.filter((F.col("errors") >= threshold) & in_active_hours(F.col("timestamp"), *hours))
    return found if started_at is None else after_grace(found, started_at, grace_s)


def spike_alerts(
    tracked: DataFrame,
    window_s: int = C.SPIKE_WINDOW_S,
    threshold: int = C.SPIKE_THRESHOLD,
    cooldown_s: int = C.SPIKE_COOLDOWN_S,
    hours: tuple[int | None, int | None] = (None, None),
    started_at: dt.datetime | None = None,
    grace_s: int = C.STARTUP_GRACE_S,
) -> DataFrame:
    """Fired spikes: candidates that respect the cooldown, with the window count."""
    candidates = spike_candidates(tracked, window_s, threshold, hours, started_at, grace_s)
    fires = cooldown_fires(candidates, [], "timestamp", cooldown_s)
    return fires.join(candidates, "timestamp")


def critical_alerts(df: DataFrame, cooldown_s: int = C.CRITICAL_COOLDOWN_S, **rules) -> DataFrame:
    """Per message (first 100 characters): fire unless it fired less than ``cooldown_s`` ago."""
    rows = df.filter(F.col("level").isin("ERROR", "CRITICAL")).filter(
        alertable(F.col("level"), F.col("service"), F.col("message"), F.col("timestamp"), **rules)
    )
    keyed = rows.select(F.substring("message", 1, 100).alias("message"), "timestamp")
    return cooldown_fires(keyed, ["message"], "timestamp", cooldown_s)


class Limiter:
    """What one key has sent, second by second, and since when its circuit is open."""

    def __init__(self, window_s: int, max_sent: int, open_s: int, sent: dict[int, int] | None = None, opened: int | None = None):
        self.window_s, self.max_sent, self.open_s = window_s, max_sent, open_s
        self.sent, self.opened = dict(sent or {}), opened

    def step(self, now: int, attempts: int) -> tuple[int, int, int]:
        """(sent, rate limited, stopped by the open circuit) of the attempts of one second."""
        if self.opened is not None and now < self.opened + self.open_s:
            return 0, 0, attempts
        self.sent = {at: n for at, n in self.sent.items() if at >= now - self.window_s}
        granted = min(attempts, max(0, self.max_sent - sum(self.sent.values())))
        if granted:
            self.sent[now] = granted
        over = attempts - granted
        self.opened = now if over else None
        return granted, min(over, 1), max(over - 1, 0)


class Recovery:
    """Errors in the window and recent restarts of one service; one step per second with errors."""

    def __init__(
        self,
        window_s: int,
        threshold: int,
        cooldown_s: int,
        per_hour: int,
        errors: Sequence[tuple[int, int]] = (),
        restarts: Sequence[int] = (),
    ):
        self.window_s, self.threshold, self.cooldown_s, self.per_hour = window_s, threshold, cooldown_s, per_hour
        self.errors, self.restarts = deque(errors), deque(restarts)

    def step(self, now: int, n: int) -> tuple[str, int] | None:
        """(action, errors that led to it), or None."""
        while self.errors and now - self.errors[0][0] > self.window_s:
            self.errors.popleft()
        held = sum(c for _, c in self.errors)
        due = max(self.threshold, held + 1)  # the error of this second that decides
        self.errors.append((now, n))
        if held + n < due or (self.restarts and now - self.restarts[-1] < self.cooldown_s):
            return None
        while self.restarts and self.restarts[0] <= now - 3600:
            self.restarts.popleft()
        if len(self.restarts) >= self.per_hour:
            return "restart_limit", due
        self.restarts.append(now)
        # Errors that follow in the same second count toward the next restart.
        self.errors = deque([(now, held + n - due)])
        return "restart", due


def rate_limit(
    attempts: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    window_s: int = C.RATE_WINDOW_S,
    max_sent: int = C.RATE_MAX,
    open_s: int = C.CIRCUIT_OPEN_S,
) -> DataFrame:
    """Per second of send attempts: how many were sent, rate limited, or met an open circuit.

    At most ``max_sent`` per window; one more opens the circuit for
    ``open_s``; then a probe goes out and closes it. A pause of both spans
    forgets everything, so runs between pauses are walked side by side. Within
    a run only (second, attempts) rows of one key are walked; there has to be a
    key, so that no limiter sees everything.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a limiter needs a key")
    seconds = attempts.groupBy(*keys, to_second(ts).alias("at")).agg(F.count("*").alias("attempts"))
    runs = sessions(seconds, keys, "at", max(window_s, open_s) + 1)
    runs = runs.withColumn("__s", F.unix_seconds(F.col("at").cast("timestamp")))
    types = dict(runs.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__s").reset_index(drop=True)
        limiter = Limiter(window_s, max_sent, open_s)
        steps = [limiter.step(int(now), int(n)) for now, n in zip(pdf["__s"], pdf["attempts"])]
        return pd.concat([pdf[[*keys, "at"]], pd.DataFrame(steps, columns=["sent", "rate_limited", "circuit_open"])], axis=1)

    return runs.groupBy(*keys, "session").applyInPandas(
        walk, f"{head}at timestamp_ntz, sent long, rate_limited long, circuit_open long"
    )


def recovery_decisions(
    errors: DataFrame,
    key: str = "service",
    ts: str = "timestamp",
    window_s: int = C.RECOVERY_WINDOW_S,
    threshold: int = C.RECOVERY_THRESHOLD,
    cooldown_s: int = C.RECOVERY_COOLDOWN_S,
    per_hour: int = C.RECOVERY_PER_HOUR,
    restartable: Sequence[str] | None = None,
) -> DataFrame:
    """(service, at, action, errors) rows: ``restart`` or ``restart_limit``.

    A service with ``threshold`` errors in the window restarts, which clears
    its window; not within the cooldown, and not more than ``per_hour`` times
    an hour. After an hour of silence nothing is remembered, which is where
    runs are cut; a run is walked by (second, errors) rows. Only services of
    ``restartable`` are watched, by default all.
    """
    if restartable is not None:
        errors = errors.filter(F.col(key).isin(list(restartable)))
    seconds = errors.groupBy(key, to_second(ts).alias("at")).agg(F.count("*").alias("n"))
    runs = sessions(seconds, [key], "at", max(3600, window_s, cooldown_s) + 1)
    runs = runs.withColumn("__s", F.unix_seconds(F.col("at").cast("timestamp")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__s")
        service = Recovery(window_s, threshold, cooldown_s, per_hour)
        rows = []
        for name, at, now, n in zip(pdf[key], pdf["at"], pdf["__s"], pdf["n"]):
            decision = service.step(int(now), int(n))
            if decision:
                rows.append((name, at, *decision))
        return pd.DataFrame(rows, columns=[key, "at", "action", "errors"])

    return runs.groupBy(key, "session").applyInPandas(
        walk, f"`{key}` {dict(runs.dtypes)[key]}, at timestamp_ntz, action string, errors long"
    )


def alert_status(
    errors: DataFrame,
    sent: DataFrame,
    starts: DataFrame,
    as_of: dt.datetime,
    window_s: int = C.SPIKE_WINDOW_S,
    rate_window_s: int = C.RATE_WINDOW_S,
    max_sent: int = C.RATE_MAX,
    grace_s: int = C.STARTUP_GRACE_S,
    key: str = "service",
) -> DataFrame:
    """What stands between each service and its next alert at ``as_of``.

    Errors in the window, alerts sent in the rate window and how many are
    left, seconds since the last one, and what remains of the grace after the
    last start. ``errors`` and ``starts`` have (key, timestamp), ``sent`` has
    (key, at, sent). Each side is folded to one row a service before they meet.
    """
    now = F.lit(as_of).cast("timestamp_ntz")

    def ago(ts: str) -> Column:
        return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000

    within = errors.filter((ago("timestamp") >= 0) & (ago("timestamp") <= window_s)).groupBy(key).agg(F.count("*").alias("in_window"))
    out = sent.filter((ago("at") >= 0) & (F.col("sent") > 0)).groupBy(key).agg(
        F.sum(F.when(ago("at") <= rate_window_s, F.col("sent")).otherwise(0)).alias("sent_in_window"), F.floor(F.min(ago("at"))).alias("last_sent_ago")
    )
    begun = starts.filter(ago("timestamp") >= 0).groupBy(key).agg(F.min(ago("timestamp")).alias("__up"))
    rows = within.join(out, key, "full_outer").join(begun, key, "full_outer")
    count = F.coalesce("sent_in_window", F.lit(0).cast("long"))
    remaining = F.greatest(F.lit(0.0), F.lit(grace_s) - F.coalesce("__up", F.lit(float(grace_s))))
    return rows.select(
        key,
        F.coalesce("in_window", F.lit(0).cast("long")).alias("in_window"),
        count.alias("sent_in_window"),
        F.greatest(F.lit(0).cast("long"), F.lit(max_sent) - count).alias("may_send"),
        "last_sent_ago",
        F.ceil(remaining).alias("grace_remaining"),
    )


def last_actions(decisions: DataFrame, n: int = 10) -> DataFrame:
    return decisions.orderBy(F.desc("at"), F.asc("service")).limit(n)
