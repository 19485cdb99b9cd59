"""Stateful alert streams. State is a few numbers per key; input is at most one row per key and second.

The per-second count is an ordinary windowed aggregate: it combines before
the shuffle, takes the watermark's late-data rule, and hands closed seconds
in order of time to the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.functions import constants as C
from tallyloom.operators.alerts import Limiter, Recovery

SLOT_S = 3600  # shortest stretch of a key's time that is counted on its own


def per_second(
    stream: DataFrame, keys: Mapping[str, Column], condition: Column | None = None, watermark: str = "10 minutes", ts: str = "timestamp"
) -> DataFrame:
    """(keys, at, s, n): closed seconds with their number of rows that meet the condition.

    All rows move the watermark, also those that are not counted: a filter
    would leave the last seconds of a quiet stream open. Rows not counted
    share one group per second.
    """
    counted = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    marked = timed.select(ts, counted.alias("__hit"), *[F.when(counted, c).alias(k) for k, c in keys.items()])
    return (
        marked.groupBy(F.window(ts, "1 second").alias("w"), *keys)
        .agg(F.count_if("__hit").alias("n"))
        .filter(F.col("n") > 0)
        .select(*keys, F.col("w.start").alias("at"), F.unix_seconds("w.start").alias("s"), "n", F.window_time("w").alias("closed"))
    )


class _Seconds(StatefulProcessor):
    """Feeds the seconds of a key in order of time; subclasses keep the state.

    A key that stays silent for ``keep_s`` of event time is forgotten, so the
    state holds recent keys only.
    """

    keep_s = 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "packed string")
        self.seen = handle.getValueState("seen", "s long")

    def load(self) -> dict | None:
        import json

        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def store(self, value: dict) -> None:
        import json

        self.state.update((json.dumps(value),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seconds = pd.concat(list(rows)).sort_values("s")  # one micro-batch of closed seconds
        latest = int(seconds["s"].iloc[-1])
        self.seen.update((latest,))
        self.handle.registerTimer((latest + self.keep_s + 1) * 1000)
        yield self.walk(key, seconds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.seen.exists() and self.seen.get()[0] + self.keep_s < due:
            self.state.clear()
            self.seen.clear()
        return iter([])

    def walk(self, key, seconds: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class CooldownProcessor(_Seconds):
    """Fires unless the key fired less than the cooldown ago."""

    def __init__(self, key: str, cooldown_s: int):
        self.key, self.cooldown_s = key, cooldown_s
        self.keep_s = max(cooldown_s, self.keep_s)

    def walk(self, key, seconds: pd.DataFrame) -> pd.DataFrame:
        state = self.load()
        last = state["last"] if state else None
        fired = []
        for at, now in zip(seconds["at"], seconds["s"]):
            if last is None or now - last >= self.cooldown_s:
                last = int(now)
                fired.append(at)
        self.store({"last": last})
        return pd.DataFrame({self.key: [key[0]] * len(fired), "at": fired})


class RecoveryProcessor(_Seconds):
    def __init__(self, window_s: int, threshold: int, cooldown_s: int, per_hour: int):
        self.rules = (window_s, threshold, cooldown_s, per_hour)
        self.keep_s = max(window_s, cooldown_s, self.keep_s)

    def walk(self, key, seconds: pd.DataFrame) -> pd.DataFrame:
        state = self.load() or {"errors": [], "restarts": []}
        service = Recovery(*self.rules, [tuple(e) for e in state["errors"]], state["restarts"])
        rows = []
        for at, now, n in zip(seconds["at"], seconds["s"], seconds["n"]):
            decision = service.step(int(now), int(n))
            if decision:
                rows.append((key[0], at, *decision))
        self.store({"errors": list(service.errors), "restarts": list(service.restarts)})
        return pd.DataFrame(rows, columns=["service", "at", "action", "errors"])


class LimiterProcessor(_Seconds):
    """Sends, limits and open circuits of one key."""

    def __init__(self, key: str, window_s: int, max_sent: int, open_s: int):
        self.key, self.rules = key, (window_s, max_sent, open_s)
        self.keep_s = max(window_s, open_s, self.keep_s)

    def walk(self, key, seconds: pd.DataFrame) -> pd.DataFrame:
        state = self.load() or {"sent": [], "opened": None}
        limiter = Limiter(*self.rules, {at: n for at, n in state["sent"]}, state["opened"])
        steps = [limiter.step(int(now), int(n)) for now, n in zip(seconds["s"], seconds["n"])]
        self.store({"sent": [[int(at), int(n)] for at, n in limiter.sent.items()], "opened": limiter.opened})
        rows = [(key[0], at, *step) for at, step in zip(seconds["at"], steps)]
        return pd.DataFrame(rows, columns=[self.key, "at", "sent", "rate_limited", "circuit_open"])


class SlidingProcessor(StatefulProcessor):
    """How many rows of a key are at most ``window_s`` old, at every second of a slot with rows.

    Keys are (key, slot): a slot sees its own seconds and, before them, those
    of the slot before that still count in it. A slot that the watermark has
    not passed keeps the seconds inside its last window; one that it has
    passed keeps nothing, and what it kept goes by an event-time timer.
    """

    def __init__(self, key: str, window_s: int, slot_s: int):
        self.key, self.window_s, self.slot_s = key, window_s, slot_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "s long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        fresh = pd.concat(list(rows)).sort_values("s")  # one micro-batch of closed seconds of a slot
        held = list(self.held.get()) if self.held.exists() else []
        known = pd.DataFrame(held, columns=["s", "n"], dtype="int64")
        every = pd.concat([known, fresh[["s", "n"]]]).sort_values("s")
        s, total = every["s"].to_numpy(), np.concatenate([[0], np.cumsum(every["n"].to_numpy())])
        own = fresh[fresh["s"] // self.slot_s == key[1]]
        now = own["s"].to_numpy()
        counts = total[np.searchsorted(s, now, "right")] - total[np.searchsorted(s, now - self.window_s, "left")]
        end = (key[1] + 1) * self.slot_s * 1000
        if timerValues.getCurrentWatermarkInMs() < end:
            last = every[s >= s[-1] - self.window_s]
            self.held.put(list(zip(last["s"].tolist(), last["n"].tolist(), strict=True)))
            if not held:
                self.handle.registerTimer(end)
        elif held:
            self.held.clear()
        if len(own):
            yield pd.DataFrame({self.key: [key[0]] * len(own), "at": list(own["at"]), "in_window": counts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def _stateful(seconds: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return seconds.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _is_error() -> Column:
    return F.col("level").isin("ERROR", "CRITICAL")


def critical_alert_stream(logs: DataFrame, cooldown_s: int = C.CRITICAL_COOLDOWN_S, watermark: str = "10 minutes") -> DataFrame:
    seconds = per_second(logs, {"message": F.substring("message", 1, 100)}, _is_error(), watermark)
    return _stateful(seconds, ["message"], CooldownProcessor("message", cooldown_s), "message string, at timestamp")


def recovery_stream(
    logs: DataFrame,
    window_s: int = C.RECOVERY_WINDOW_S,
    threshold: int = C.RECOVERY_THRESHOLD,
    cooldown_s: int = C.RECOVERY_COOLDOWN_S,
    per_hour: int = C.RECOVERY_PER_HOUR,
    restartable: Sequence[str] | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    watched = _is_error() if restartable is None else _is_error() & F.col("service").isin(list(restartable))
    return _stateful(
        per_second(logs, {"service": F.col("service")}, watched, watermark),
        ["service"],
        RecoveryProcessor(window_s, threshold, cooldown_s, per_hour),
        "service string, at timestamp, action string, errors long",
    )


def sliding_count_stream(
    logs: DataFrame, key: str = "service", window_s: int = 600, condition: Column | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """(key, at, in_window): at every second with errors of a key, its errors aged 0 to ``window_s`` seconds, exactly."""
    counted = per_second(logs, {key: F.col(key)}, _is_error() if condition is None else condition, watermark)
    # A key's time is cut into slots, so that a busy key is counted by many tasks; a second late in a slot also counts in the next.
    slot_s = max(window_s, SLOT_S)
    slots = F.sequence(F.floor(F.col("s") / slot_s), F.floor((F.col("s") + window_s) / slot_s))
    processor = SlidingProcessor(key, window_s, slot_s)
    return _stateful(counted.withColumn("slot", F.explode(slots)), [key, "slot"], processor, f"`{key}` string, at timestamp, in_window long")


def rate_limit_stream(
    logs: DataFrame,
    key: str = "service",
    condition: Column | None = None,
    window_s: int = C.RATE_WINDOW_S,
    max_sent: int = C.RATE_MAX,
    open_s: int = C.CIRCUIT_OPEN_S,
    watermark: str = "10 minutes",
) -> DataFrame:
    """(key, at, sent, rate_limited, circuit_open): the limiter's answer to the attempts of every second of a key."""
    counted = per_second(logs, {key: F.col(key)}, _is_error() if condition is None else condition, watermark)
    schema = f"`{key}` string, at timestamp, sent long, rate_limited long, circuit_open long"
    return _stateful(counted, [key], LimiterProcessor(key, window_s, max_sent, open_s), schema)
