"""Log lines and container metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions.text import any_word, literal_map


def infer_log_level(message: Column) -> Column:
    """Level from the text; a fine HTTP status wins over any word, then the order below counts."""
    lowered = F.lower(message)
    return (
        F.when(message.rlike(C.HTTP_FINE), "INFO")
        .when(lowered.rlike("error|exception"), "ERROR")
        .when(lowered.rlike("warn"), "WARN")
        .when(lowered.rlike("critical|fatal"), "CRITICAL")
        .otherwise("INFO")
    )


def parse_log_line(message: Column) -> Column:
    """Struct (level, message): the inner message of ``{"s": .., "msg": ..}`` JSON, else the line.

    The whole line has to be one JSON object with both keys, whatever their
    values; a null inner message stays null.
    """
    short = F.get_json_object(message, "$.s")
    inner = F.get_json_object(message, "$.msg")
    keys = F.json_object_keys(message)
    # Text behind the object would be passed over; as the one element of an array it is not.
    whole = F.json_array_length(F.concat(F.lit("["), message, F.lit("]"))) == 1
    structured = F.coalesce(whole & F.array_contains(keys, "s") & F.array_contains(keys, "msg"), F.lit(False))
    level = (
        F.when(short == "F", "CRITICAL").when(short == "E", "ERROR").when(short == "W", "WARN").otherwise("INFO")
    )
    return F.struct(
        F.when(structured, level).otherwise(infer_log_level(message)).alias("level"),
        F.when(structured, inner).otherwise(message).alias("message"),
    )


def container_from_fields(*names: Column) -> Column:
    """First non-empty of the nested name fields."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def container_id(path: Column) -> Column:
    """The 64-digit hex id in a container log path, NULL without one."""
    return F.nullif(F.regexp_extract(path, C.CONTAINER_ID_IN_PATH, 1), F.lit(""))


def container_in_text(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, C.CONTAINER_IN_TEXT, 1), F.lit(""))


def strip_slash(name: Column) -> Column:
    return F.coalesce(F.regexp_replace(name, "^/", ""), F.lit(""))


def service_of(container: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.CONTAINER_SERVICE), container), F.lit("unknown"))


def log_doc_id(container: Column, timestamp: Column, message: Column) -> Column:
    return F.concat_ws("_", container, timestamp, F.substring(F.md5(message), 1, 8))


def cpu_percent(usage: Column, before: Column, system: Column, system_before: Column, strict: bool = True) -> Column:
    """CPU share between two counter readings, in percent.

    ``strict`` asks for positive counters and a positive difference; the
    snapshot form only needs the system counter to have moved.
    """
    used, passed = usage - before, system - system_before
    fine = passed > 0
    if strict:
        fine = fine & (system > 0) & (system_before > 0) & (used > 0)
    return F.when(fine, used / passed * 100.0).otherwise(F.lit(0.0))


def memory_percent(usage: Column, limit: Column) -> Column:
    return F.when(limit > 0, usage / limit * 100.0).otherwise(F.lit(0.0))


def service_prefix(container: Column) -> Column:
    return F.substring_index(container, "-", 1)


def mb(size: Column) -> Column:
    return size / 1024 / 1024


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[x for k, v in C.LEVEL_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(0))


def in_active_hours(ts: Column, start: int | None, end: int | None) -> Column:
    """Is the Seoul hour inside [start, end)? The range may wrap midnight; no bounds means always."""
    if start is None or end is None:
        return F.lit(True)
    hour = F.hour(F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Seoul"))
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def is_startup_noise(message: Column) -> Column:
    return F.lower(message).rlike(any_word(C.STARTUP_NOISE))
