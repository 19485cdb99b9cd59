"""Keyed writes as DataFrame transforms: the state after the write is the result.

The base is joined to the delta on the key only. A delta that fits Spark's
broadcast threshold never moves the base (``small_delta``); a larger one costs
one exchange of each side. ``delta`` must hold one row per key, see
``ranking.last_wins``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def _take_new(old: Column, new: Column) -> Column:
    return new


def _new_unless_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def _merge(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    rule: Rule,
    small_delta: bool,
    insert_only: Sequence[str] = (),
) -> DataFrame:
    keys = list(keys)
    columns = [c for c in columns if c not in keys]
    out_columns = keys + [c for c in base.columns if c not in keys]
    out_columns += [c for c in columns if c not in out_columns]
    types = {**dict(delta.dtypes), **dict(base.dtypes)}
    new = delta.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__in_delta"))
    old = base.withColumn("__in_base", F.lit(True))

    def value(name: str) -> Column:
        before = F.col(name) if name in base.columns else F.lit(None)
        before = before.cast(types[name])
        if name not in columns:
            return before.alias(name)
        after = F.col(f"__new_{name}").cast(types[name])
        merged = F.when(F.col("__in_base").isNull(), after).when(
            F.col("__in_delta"), before if name in insert_only else rule(before, after)
        )
        return merged.otherwise(before).alias(name)

    def project(joined: DataFrame) -> DataFrame:
        return joined.select(*keys, *[value(c) for c in out_columns if c not in keys])

    if not small_delta:
        return project(old.join(new, keys, "full_outer"))
    known = base.join(delta.select(*keys), keys, "left_semi").select(*keys).distinct()
    fresh = new.join(known, keys, "left_anti")
    for name in old.columns:
        if name not in keys:
            fresh = fresh.withColumn(name, F.lit(None).cast(dict(old.dtypes)[name]))
    return project(old.join(new, keys, "left")).unionByName(project(fresh))


def upsert_full(base: DataFrame, delta: DataFrame, keys: Sequence[str], small_delta: bool = False) -> DataFrame:
    """Set every delta field on a match, insert otherwise; other base fields stay."""
    return _merge(base, delta, keys, delta.columns, _take_new, small_delta)


def upsert_columns(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str], small_delta: bool = False
) -> DataFrame:
    """Set a fixed column subset; a column the delta lacks becomes NULL on a match."""
    for name in columns:
        if name not in delta.columns:
            delta = delta.withColumn(name, F.lit(None).cast(dict(base.dtypes).get(name, "string")))
    return _merge(base, delta, keys, columns, _take_new, small_delta)


def merge_partial(base: DataFrame, delta: DataFrame, keys: Sequence[str], small_delta: bool = False) -> DataFrame:
    """Update or insert partial documents; NULL in the delta means the field is absent."""
    return _merge(base, delta, keys, delta.columns, _new_unless_null, small_delta)


def upsert_on_conflict(
    base: DataFrame,
    delta: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    keep_old_when_null: bool = False,
    small_delta: bool = False,
) -> DataFrame:
    """ON CONFLICT DO UPDATE of the named columns; new keys bring all their columns."""
    rule = _new_unless_null if keep_old_when_null else _take_new
    others = [c for c in delta.columns if c not in update]
    return _merge(base, delta, keys, delta.columns, rule, small_delta, others)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    fresh = delta.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def touch_latest(events: DataFrame, keys: Sequence[str], ts: str = "at") -> DataFrame:
    """One row per key with its latest time; combined before the shuffle."""
    return events.groupBy(*keys).agg(F.max(ts).alias(ts))


def last_action(events: DataFrame, keys: Sequence[str], action: str = "action", ts: str = "at") -> DataFrame:
    """The last action of each key with its time and event id. Equal times: the later event id decides.

    What it returns may be put together with further events, and it asked again.
    """
    last = events.groupBy(*keys).agg(F.max(F.struct(F.col(ts), F.col("event_id"), F.col(action))).alias("__last"))
    return last.select(*keys, F.col(f"__last.{action}").alias(action), F.col(f"__last.{ts}").alias(ts), "__last.event_id")


def toggle_state(events: DataFrame, keys: Sequence[str], on: str, action: str = "action", ts: str = "at") -> DataFrame:
    """Current members: keys whose last action is ``on``. Equal times: the later event id decides."""
    order = F.struct(F.col(ts), F.col("event_id"))
    last = events.groupBy(*keys).agg(F.max_by(action, order).alias("__last"), F.max(ts).alias(ts))
    return last.filter(F.col("__last") == on).drop("__last")


def replace_by_key(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every base row of a key present in the delta, then add the delta's rows."""
    kept = base.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(delta, allowMissingColumns=True)


def cascade_delete(
    tables: Mapping[str, DataFrame], doomed: DataFrame, key: str = "product_id", offer_key: str = "offer_id"
) -> dict[str, DataFrame]:
    """Remove products, what belongs to them, and search logs that point at their offers."""
    gone_offers = tables["offers"].join(doomed, key, "left_semi").select(offer_key)
    out = {name: tables[name].join(doomed, key, "left_anti") for name in ("offers", "features", "products")}
    out["search_logs"] = tables["search_logs"].join(gone_offers, offer_key, "left_anti")
    return out


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that stay (NULL conditions stay, as in SQL) and a one-row count of those removed."""
    hit = F.coalesce(condition, F.lit(False))
    return df.filter(~hit), df.agg(F.count_if(hit).alias("deleted_count"))


def split_rejected(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and apart those that do not (NULL does not)."""
    fine = F.coalesce(condition, F.lit(False))
    return df.filter(fine), df.filter(~fine)


def purge_cutoff(df: DataFrame, ts: str, cutoff: dt.datetime) -> DataFrame:
    """Ignore what is older than the purge marker."""
    return df.filter(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def retain_days(df: DataFrame, ts: str, days: int, as_of: dt.datetime) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz"))


def increment_counter(base: DataFrame, events: DataFrame, keys: Sequence[str], counter: str = "view_count") -> DataFrame:
    """counter = counter + number of events of the key; counted before the join."""
    seen = events.groupBy(*keys).agg(F.count("*").alias("__n"))
    return (
        base.join(seen, list(keys), "left")
        .withColumn(counter, F.coalesce(F.col(counter), F.lit(0)) + F.coalesce(F.col("__n"), F.lit(0)))
        .drop("__n")
    )


def add_counts(base: DataFrame, counts: DataFrame, keys: Sequence[str], counter: str = "view_count") -> DataFrame:
    """counter = counter + ``n`` of ``counts`` (keys, n), one row per key; keys the base lacks are left out."""
    added = F.coalesce(F.col(counter), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))
    return base.join(counts.select(*keys, "n"), list(keys), "left").withColumn(counter, added).drop("n")


def evolve_schema(
    df: DataFrame,
    rename: Mapping[str, str] | None = None,
    add: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    widen: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename, drop, add where missing, widen; a second run changes nothing."""
    for old, new in (rename or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.drop(*drop)
    missing = {n: F.lit(None).cast(t) for n, t in (add or {}).items() if n not in df.columns}
    casts = {n: F.col(n).cast(t) for n, t in (widen or {}).items() if n in df.columns}
    return reduce(lambda d, cols: d.withColumns(cols) if cols else d, (missing, casts), df)


def snapshot_results(results: DataFrame, log_key: str = "log_id", list_column: str = "results") -> DataFrame:
    """One row per search result with its rank 1..n, denormalised."""
    return results.select(log_key, F.posexplode(list_column).alias("__pos", "r")).select(
        log_key, (F.col("__pos") + 1).alias("rank"), "r.*"
    )
