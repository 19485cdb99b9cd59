"""Log and metric aggregations. All combine map-side; none collects a group."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.functions.logs import mb
from tallyloom.operators.ranking import best_per_key

def _is_error(level: str = "level") -> Column:
    return F.col(level).isin("ERROR", "CRITICAL")


def count_by(df: DataFrame, field: str, top: int) -> DataFrame:
    """Rows per value, the ``top`` most frequent; equal counts by value."""
    counts = df.groupBy(field).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), F.asc(field)).limit(top)


def hour_bucket(ts: str = "timestamp") -> Column:
    return F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz")


def fill_hours(trend: DataFrame, columns: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Add the empty hours between buckets with zeros, without reading the input again.

    Every bucket is stretched up to the next one. Only buckets are ordered,
    one row per hour of the lookback.
    """
    following = F.lead("bucket").over(Window.partitionBy(*within).orderBy("bucket"))
    hour = F.expr("interval 1 hour")
    stretched = trend.withColumn("__next", following).withColumn(
        "__hour", F.explode_outer(F.sequence("bucket", F.coalesce(F.col("__next") - hour, F.col("bucket")), hour))
    )
    kept = [c for c in trend.columns if c != "bucket" and c not in columns]
    return stretched.select(
        F.col("__hour").alias("bucket"),
        *kept,
        *[F.when(F.col("__hour").eqNullSafe(F.col("bucket")), F.col(c)).otherwise(F.lit(0)).alias(c) for c in columns],
    )


def _level_sums(count: Column) -> list[Column]:
    """Conditional sums; ERROR takes CRITICAL in."""
    zero = F.lit(0)
    return [
        F.sum(F.when(_is_error(), count).otherwise(zero)).alias("errors"),
        F.sum(F.when(F.col("level") == "WARN", count).otherwise(zero)).alias("warns"),
        F.sum(F.when(F.col("level") == "INFO", count).otherwise(zero)).alias("infos"),
    ]


def log_trend(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hourly errors, warnings and infos without gaps."""
    counts = df.groupBy(hour_bucket(ts).alias("bucket")).agg(*_level_sums(F.lit(1)))
    return fill_hours(counts, ["errors", "warns", "infos"])


def top_errors(df: DataFrame, n: int = 5, services: int = 5, longest: int | None = None) -> DataFrame:
    """The n most frequent error messages with their top services, last time and its container.

    Messages over ``longest`` characters are no keys and not counted; by default all are.

    Counted per (message, service) before anything is ordered, so a message
    seen everywhere is as many rows as there are services.
    """
    errors = df.filter(_is_error() if longest is None else _is_error() & (F.length("message") <= longest))
    return _worst(errors.groupBy("message", "service").agg(F.count("*").alias("c"), _latest().alias("last")), n, services)


def _latest() -> Column:
    return F.max(F.struct("timestamp", "event_id", "container"))


def _worst(cells: DataFrame, n: int = 5, services: int = 5) -> DataFrame:
    """The most frequent messages of (message, service, c, last) rows."""
    message = Window.partitionBy("message")
    ranked = cells.select(
        "message",
        "service",
        F.sum("c").over(message).alias("count"),
        F.max("last").over(message).alias("last"),
        F.row_number().over(message.orderBy(F.desc("c"), F.asc("service"))).alias("r"),
    ).filter(F.col("r") <= services)
    return (
        ranked.groupBy("message", "count", "last")
        .agg(F.sort_array(F.collect_list(F.struct("r", "service"))).alias("s"))
        .orderBy(F.desc("count"), F.asc("message"))
        .limit(n)
        .select("message", "count", F.col("s.service").alias("services"), F.col("last.timestamp").alias("last_seen"), "last.container")
    )


def health_status(rate: Column, errors: Column, warns: Column) -> Column:
    return (
        F.when((rate > 10) | (errors > 20), "critical").when((rate > 3) | (warns > 10), "warning").otherwise("healthy")
    )


def _rate(errors: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(errors / total * 100, 2)).otherwise(F.lit(0.0))


def service_health(df: DataFrame) -> DataFrame:
    sums = df.groupBy("service").agg(F.count("*").alias("total"), *_level_sums(F.lit(1))).drop("infos")
    return sums.withColumn("error_rate", _rate(F.col("errors"), F.col("total"))).withColumn(
        "status", health_status(F.col("error_rate"), F.col("errors"), F.col("warns"))
    )


def dashboard(
    df: DataFrame,
    as_of: dt.datetime,
    hours: int = 24,
    recent_hours: int = 1,
    levels_listed: int | None = None,
    services_listed: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Stats, trend, health and top errors as one (section, key, metric, value, text) table.

    Levels, services and their health cover ``recent_hours``, the trend and
    the top errors ``hours``. Every level and service is listed unless the
    limits say otherwise.

    The lookback is scanned once for the three counting sections: it is folded
    to (hour, recent, service, level) counts before the shuffle, and each of
    those few rows then counts toward its level, its service and its hour.
    Only top errors, which need the messages, read it a second time.
    """
    window = df.filter(P.since(F.col("timestamp"), as_of, hours))
    cube = window.groupBy(
        hour_bucket().alias("bucket"),
        P.since(F.col("timestamp"), as_of, recent_hours).alias("recent"),
        "service",
        "level",
    ).agg(F.count("*").alias("n"))
    return _dashboard(cube, top_errors(window, longest=longest), levels_listed, services_listed)


def _dashboard(cube: DataFrame, worst: DataFrame, levels_listed: int | None, services_listed: int | None) -> DataFrame:
    """The sections of a (bucket, recent, service, level, n) cube, and of the messages counted beside it."""
    no_hour = F.lit(None).cast("timestamp_ntz")

    def member(section: str, key: Column, hour: Column) -> Column:
        return F.struct(F.lit(section).alias("of"), key.alias("key"), hour.alias("bucket"))

    hour_of = member("hour", F.lit(None).cast("string"), F.col("bucket"))
    members = F.when(
        F.col("recent"),
        F.array(member("level", F.col("level"), no_hour), member("service", F.col("service"), no_hour), hour_of),
    ).otherwise(F.array(hour_of))
    sums = (
        cube.select(F.explode(members).alias("m"), "level", "n")
        .groupBy("m.of", "m.key", "m.bucket")
        .agg(F.sum("n").alias("total"), *_level_sums(F.col("n")))
    )
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("total"), F.asc("key")))
    listed = F.when(F.col("of") == "level", F.lit(levels_listed)).when(F.col("of") == "service", F.lit(services_listed)).cast("int")
    kept = sums.withColumn("__place", place).filter(listed.isNull() | (F.col("__place") <= listed)).drop("__place")
    full = fill_hours(kept, ["total", "errors", "warns", "infos"], within=["of"])

    def entry(section: str, metric: str, value: Column | None, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    levels = F.array(entry("by_level", "rows", F.col("total")))
    rate = _rate(F.col("errors"), F.col("total"))
    services = F.array(
        entry("by_service", "rows", F.col("total")),
        entry("health", "total", F.col("total")),
        entry("health", "errors", F.col("errors")),
        entry("health", "warns", F.col("warns")),
        entry("health", "error_rate", rate),
        entry("health", "status", None, health_status(rate, F.col("errors"), F.col("warns"))),
    )
    trend = F.array(*[entry("trend", c, F.col(c)) for c in ("errors", "warns", "infos")])
    entries = F.when(F.col("of") == "level", levels).when(F.col("of") == "service", services).otherwise(trend)
    key = F.coalesce("key", F.date_format("bucket", "yyyy-MM-dd HH:mm"))
    counted = full.select(key.alias("key"), F.explode(entries).alias("e")).select("e.section", "key", "e.metric", "e.value", "e.text")
    facts = F.array(
        entry("top_errors", "count", F.col("count")),
        entry("top_errors", "services", None, F.array_join("services", ",")),
        entry("top_errors", "last_seen", None, F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")),
        entry("top_errors", "container", None, F.col("container")),
    )
    top = worst.select(F.col("message").alias("key"), F.explode(facts).alias("e"))
    return counted.unionByName(top.select("e.section", "key", "e.metric", "e.value", "e.text"))


ROLLUP_KEYS = ["bucket", "service", "level", "message"]


def hourly_rollup(df: DataFrame, longest: int | None = None) -> DataFrame:
    """(bucket, service, level, message, n, last) per hour: what the dashboard needs to know of it.

    Only errors keep their message, and of those only messages of at most
    ``longest`` characters. Rollups of two sets of rows, put together by
    ``merged_rollup``, are the rollup of both.
    """
    named = _is_error() if longest is None else _is_error() & (F.length("message") <= longest)
    rows = df.select(hour_bucket().alias("bucket"), "service", "level", F.when(named, F.col("message")).alias("message"), "timestamp", "event_id", "container")
    return rows.groupBy(*ROLLUP_KEYS).agg(F.count("*").alias("n"), _latest().alias("last"))


def merged_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ROLLUP_KEYS).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def dashboard_from_rollup(
    rollup: DataFrame,
    as_of: dt.datetime,
    hours: int = 24,
    recent_hours: int = 1,
    levels_listed: int | None = None,
    services_listed: int | None = None,
) -> DataFrame:
    """``dashboard`` from hourly rollups; ``as_of`` is a full hour."""
    if as_of.replace(minute=0, second=0, microsecond=0) != as_of:
        raise ValueError("rollups end at full hours")
    window = rollup.filter(P.since(F.col("bucket"), as_of, hours))
    recent = P.since(F.col("bucket"), as_of, recent_hours).alias("recent")
    cube = window.groupBy("bucket", recent, "service", "level").agg(F.sum("n").alias("n"))
    named = window.filter(_is_error() & F.col("message").isNotNull())
    cells = named.groupBy("message", "service").agg(F.sum("n").alias("c"), F.max("last").alias("last"))
    return _dashboard(cube, _worst(cells), levels_listed, services_listed)


def metric_stats(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Mean CPU, mean memory share and peak memory in MB by service."""

    def shown(value: Column) -> Column:
        return value if digits is None else F.round(value, digits)

    return df.groupBy("service").agg(
        shown(F.avg("cpu_percent")).alias("avg_cpu"),
        shown(F.avg("memory_percent")).alias("avg_mem"),
        shown(mb(F.max("memory_usage"))).alias("max_mem_mb"),
    )


def fleet_kpis(stats: DataFrame) -> DataFrame:
    """Mean of the service means and the services leading in memory and CPU."""

    def leader(value: str) -> Column:  # equal values: the smaller name
        return F.min_by("service", F.struct(-F.col(value), F.col("service")))

    return stats.agg(
        F.round(F.avg("avg_cpu"), 1).alias("fleet_cpu"),
        F.round(F.avg("avg_mem"), 1).alias("fleet_mem"),
        F.round(F.max("max_mem_mb"), 0).alias("top_mem_mb"),
        leader("max_mem_mb").alias("top_mem_service"),
        F.round(F.max("avg_cpu"), 1).alias("top_cpu"),
        leader("avg_cpu").alias("top_cpu_service"),
    )


def error_spike_banner(trend: DataFrame) -> DataFrame:
    """Is the last hour's error count above 5 and above three times the mean of the hours before?"""
    last = trend.agg(
        F.max_by("errors", "bucket").alias("last_errors"), F.sum("errors").alias("s"), F.count("*").alias("buckets")
    )
    mean = F.when(F.col("buckets") > 1, (F.col("s") - F.col("last_errors")) / (F.col("buckets") - 1))
    return last.select(
        "buckets",
        "last_errors",
        F.round(mean, 6).alias("mean_before"),
        F.coalesce(
            (F.col("buckets") >= 3) & (F.col("last_errors") > 5) & (F.col("last_errors") > mean * 3), F.lit(False)
        ).alias("spike"),
    )


def counts_by_day(df: DataFrame, ts: str, newest: int = 5) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("rows")).orderBy(F.desc("day")).limit(newest)


def page_meta(df: DataFrame, offset: int, size: int) -> DataFrame:
    """Total, number of pages and current page in one pass."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.ceil(F.col("total") / F.lit(size)).cast("long").alias("total_pages"),
        F.lit(offset // size + 1).cast("long").alias("page"),
    )


def spike_summary(df: DataFrame, messages: int = 3, shown: int = 80) -> DataFrame:
    """(section, rank, text, rows): services by falling count, and the first distinct short messages of all.

    Equal counts go by first appearance. Errors are folded to (service, short
    message) cells before anything is ordered; messages are a top-n, and only
    services, one row each, are ranked together.
    """
    text = F.when(F.length("message") > shown, F.concat(F.substring("message", 1, shown), F.lit("..."))).otherwise(
        F.col("message")
    )
    first = F.struct("timestamp", "event_id")
    services = df.groupBy("service").agg(F.count("*").alias("rows"), F.min(first).alias("first"))
    order = Window.orderBy(F.desc("rows"), "first")
    counted = services.select(
        F.lit("service").alias("section"), F.row_number().over(order).alias("rank"), F.col("service").alias("text"), "rows"
    )
    early = df.groupBy(text.alias("text")).agg(F.min(first).alias("first")).orderBy("first").limit(messages)
    said = early.select(
        F.lit("message").alias("section"),
        F.row_number().over(Window.orderBy("first")).alias("rank"),
        "text",
        F.lit(None).cast("long").alias("rows"),
    )
    return counted.unionByName(said)


def throughput_per_min(df: DataFrame, minutes: int = 60) -> DataFrame:
    return df.agg((F.count("*") / F.lit(minutes)).alias("per_minute"))


def detection_summary(products: DataFrame, detections: DataFrame, matched: DataFrame) -> DataFrame:
    """Inputs, raw detections, matched products, fallbacks and final images in one row."""
    hit = matched.select("product_id").distinct().withColumn("__hit", F.lit(1))
    rows = products.select("product_id").join(hit, "product_id", "left")
    tagged = rows.select(F.lit(1).alias("input"), "__hit").unionByName(
        detections.select(F.lit(None).cast("int").alias("input"), F.lit(None).cast("int").alias("__hit"))
    )
    return tagged.agg(
        F.count("input").alias("inputs"),
        F.count_if(F.col("input").isNull()).alias("raw_detections"),
        F.count("__hit").alias("matched"),
        (F.count("input") - F.count("__hit")).alias("fallback"),
        F.count("input").alias("final_images"),
    )


def load_summary(df: DataFrame, failed: Column, batch: str) -> DataFrame:
    bad = F.coalesce(failed, F.lit(False))
    return df.groupBy(batch).agg(F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def pivot_series(df: DataFrame, ts: str, field: str, known: Sequence[str], value: str, order: str) -> DataFrame:
    """Time x service matrix; the last row of a cell counts, a missing cell is NULL.

    The columns are given, so no extra job looks for them.
    """
    last = best_per_key(df.select(ts, field, value, order), [ts, field], F.desc(order))
    return last.groupBy(ts).pivot(field, list(known)).agg(F.max(value))


def window_status(df: DataFrame, as_of: dt.datetime, window_s: int, ts: str = "timestamp") -> DataFrame:
    """Errors per service younger than ``window_s`` at ``as_of``."""
    age_ok = P.all_of(
        F.col(ts) > F.lit(as_of - dt.timedelta(seconds=window_s)).cast("timestamp_ntz"),
        F.col(ts) <= F.lit(as_of).cast("timestamp_ntz"),
    )
    return df.filter(age_ok & _is_error()).groupBy("service").agg(F.count("*").alias("in_window"))
