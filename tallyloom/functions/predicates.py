"""Filters as boolean columns, so that Catalyst can push and reorder them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions import logs as L
from tallyloom.functions.text import any_word, clean_model_code


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that were given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equal_if(column: Column, value) -> Column | None:
    """Equality, only where a value was supplied."""
    return None if value is None else column == F.lit(value)


def contains_text(column: Column, keyword: str | None) -> Column | None:
    """Case-insensitive substring; '%' and '_' in the keyword are plain characters."""
    if not keyword:
        return None
    escaped = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def in_list(column: Column, values: Sequence[str] | str | None) -> Column | None:
    """Lower-cased column equal to, or one of, the lower-cased values."""
    if values is None:
        return None
    wanted = [values] if isinstance(values, str) else [v for v in values if v]
    return F.lower(column).isin([v.lower() for v in wanted]) if wanted else None


def exists_field(column: Column) -> Column:
    return column.isNotNull()


def since(ts: Column, as_of: dt.datetime, hours: float) -> Column:
    """Lookback as a plain range, so that file statistics can skip."""
    return ts >= F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz")


def on_day(ts: Column, day: dt.date) -> Column:
    """``ts::date = day`` written as a range on the stored column."""
    start = dt.datetime.combine(day, dt.time())
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz"))


def phrase(column: Column, value: str | None) -> Column | None:
    """Keyword field filter; nothing or 'ALL' filters nothing."""
    return None if not value or value == "ALL" else column == value


def text_phrase(column: Column, value: str | None) -> Column | None:
    """Whole-word phrase, case-insensitive."""
    if not value:
        return None
    return F.lower(column).rlike(r"\b" + any_word([value.lower()]) + r"\b")


def is_chatter(message: Column) -> Column:
    return message.rlike(any_word(C.CHATTER)) | message.rlike(C.STACK_FRAME)


def keep_log_line(message: Column, keep_errors: bool = True) -> Column:
    """False for health checks, stack frames and chatter.

    ``keep_errors`` exempts lines that carry an error mark (the intended rule);
    without it the first, unconditional drop decides (the rule as shipped).
    """
    if keep_errors:
        return ~is_chatter(message) | message.rlike(any_word(C.KEEP_MARKS))
    return ~is_chatter(message)


def mentions_core_container(line: Column) -> Column:
    return line.rlike(any_word(C.CORE_CONTAINERS))


def is_spam_title(title: Column) -> Column:
    return title.rlike(any_word(C.SPAM_WORDS))


def plausible_price(price: Column, base: Column) -> Column:
    """Strictly inside (0.3, 2.5) times the base; any price where there is no base."""
    inside = (price > base * F.lit(C.PRICE_LOW)) & (price < base * F.lit(C.PRICE_HIGH))
    return F.coalesce(base <= 0, F.lit(True)) | inside


def refine_band(price: Column, base: Column) -> Column:
    return (price > base * F.lit(C.REFINE_LOW)) & (price < base * F.lit(C.REFINE_HIGH))


def outside_refine_band(price: Column, base: Column) -> Column:
    return (price <= base * F.lit(C.REFINE_LOW)) | (price >= base * F.lit(C.REFINE_HIGH))


def has_exact_code(title: Column, model_code: Column) -> Column:
    code = F.lower(clean_model_code(F.coalesce(model_code, F.lit(""))))
    return (code != "") & F.contains(F.lower(F.replace(title, F.lit(" "), F.lit(""))), code)


def similarity_gate(is_code_query: Column, exact_code: Column, similarity: Column) -> Column:
    """Code queries need the code in the title; with the code a lower similarity will do."""
    floor = F.when(exact_code, C.SIMILARITY_FLOOR_WITH_CODE).otherwise(C.SIMILARITY_FLOOR)
    return (~is_code_query | exact_code) & (similarity >= floor)


def searchable(brand: Column, name: Column, code: Column) -> Column:
    """Enough to search for: a brand, and a name or a code."""

    def given(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) != ""

    return (F.coalesce(brand, F.lit("")) != "") & (given(name) | given(code))


def alertable(
    level: Column,
    service: Column,
    message: Column,
    ts: Column,
    *,
    enabled: bool = True,
    started_at: dt.datetime | None = None,
    grace_s: int = C.STARTUP_GRACE_S,
    hours: tuple[int | None, int | None] = (None, None),
    excluded: Sequence[str] = (),
    min_level: str = "CRITICAL",
) -> Column:
    """May this log row raise an alert?"""
    after_grace = (
        F.lit(True)
        if started_at is None
        else ts.cast("timestamp_ntz") >= F.lit(started_at + dt.timedelta(seconds=grace_s)).cast("timestamp_ntz")
    )
    return (
        F.lit(enabled)
        & after_grace
        & L.in_active_hours(ts, *hours)
        & (~service.isin(list(excluded)) if excluded else F.lit(True))
        & (L.level_rank(level) >= C.LEVEL_RANK.get(min_level, 0))
        & ~L.is_startup_noise(message)
    )


def complete_record(error: Column, name: Column, code: Column) -> Column:
    return error.isNull() & (F.coalesce(name, F.lit("")) != "") & (F.coalesce(code, F.lit("")) != "")


def big_enough(width: Column, height: Column) -> Column:
    return (width >= C.MIN_IMAGE_PIXELS) & (height >= C.MIN_IMAGE_PIXELS)


def owned_by(owner: Column, user_id: str) -> Column:
    return owner == user_id
