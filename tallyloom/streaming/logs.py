"""Log and metric streams: ingest, dedupe, hourly trend, late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import logs as L
from tallyloom.operators.aggregates import _level_sums

WATERMARK = "10 minutes"


def shape_logs(shipped: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Shipper messages as (timestamp, container, service, level, message, raw); stream or batch.

    The container comes from the first nested name, else from the id in the
    log path (``names``: container_id, name), else from the raw text.
    """

    rows = shipped.withColumn(
        "__name",
        L.container_from_fields(F.col("container.name"), F.col("docker.container.name"), F.col("fields.container")),
    )
    resolved: list[Column] = [F.col("__name")]
    if names is not None:
        known = names.select(F.col("container_id").alias("__id"), F.col("name").alias("__by_id"))
        rows = rows.withColumn("__cid", L.container_id(F.col("log.file.path"))).join(
            known, F.col("__cid") == F.col("__id"), "left"
        )
        resolved.append(F.nullif(F.col("__by_id"), F.lit("")))
    resolved.append(L.container_in_text(F.col("raw")))
    shaped = rows.withColumn("container", L.strip_slash(F.coalesce(*resolved))).withColumn(
        "__p", L.parse_log_line(F.coalesce(F.col("message"), F.lit("")))
    )
    return shaped.select(
        F.col("`@timestamp`").try_cast("timestamp").alias("timestamp"),
        "container",
        L.service_of(F.col("container")).alias("service"),
        F.col("__p.level").alias("level"),
        F.col("__p.message").alias("message"),
        "raw",
    )


def with_doc_id(logs: DataFrame) -> DataFrame:
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return logs.withColumn("doc_id", L.log_doc_id(F.col("container"), stamp, F.col("message")))


def dedupe_logs(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per container, time and message, with its document id.

    The id holds a short digest, which two messages may share, so it is not
    what tells rows apart. A stream forgets rows behind the watermark.
    """
    keyed, same = with_doc_id(logs), ["container", "timestamp", "message"]
    if keyed.isStreaming:
        return keyed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(same)
    return keyed.dropDuplicates(same)


def tumbling_trend(logs: DataFrame, hours: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Errors, warnings and infos per window; a stream emits a window once it is closed."""
    timed = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("timestamp", watermark)
    return (
        timed.groupBy(F.window("timestamp", f"{hours} hours").alias("w"))
        .agg(*_level_sums(F.lit(1)))
        .select(F.col("w.start").alias("bucket"), "errors", "warns", "infos")
    )


def split_late(batch: DataFrame, horizon: Column, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows at or after the horizon, and one row with the number of those before it."""
    late = F.col(ts) < horizon
    return batch.filter(~late), batch.agg(F.count_if(late).alias("late_rows"))


def sliding_errors(logs: DataFrame, window_s: int, slide_s: int, watermark: str = WATERMARK) -> DataFrame:
    """Streaming form of the sliding error count: hopping windows by service."""
    errors = logs.filter(F.col("level").isin("ERROR", "CRITICAL")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if errors.isStreaming:
        errors = errors.withWatermark("timestamp", watermark)
    return (
        errors.groupBy(F.window("timestamp", f"{window_s} seconds", f"{slide_s} seconds").alias("w"), "service")
        .agg(F.count("*").alias("errors"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "service", "errors")
    )
