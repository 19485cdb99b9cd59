"""Ordered operators that never send a whole key through one task.

A hot key may hold a third of all rows, and most of those in one second, so
rows are ranged over partitions by count (``sequence.placed``). What a
partition needs from its key's past is handed over as one small summary row
per key and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.sequence import carried, placed, running_sum
from tallyloom.session import stored

MICROS = 1_000_000

# Rows of a key's tables that one task follows; larger keys are followed by doubling.
FOLLOWED = 1_000


def micros(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def sliding_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "in_window") -> DataFrame:
    """Distinct (keys, ts) with the number of rows aged 0..``seconds`` (both ends in).

    Rows of equal key and time are counted first. Every time then enters the
    window with its count and leaves it again ``seconds`` later, behind what
    enters at that moment: the running sum of both is the number inside.
    """
    own = list(keys) or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(0))
    counted = df.groupBy(*own, ts).agg(F.count("*").alias("__n")).withColumn("__us", micros(ts))
    entry = F.struct(F.col("__us").alias("us"), F.lit(0).alias("leaves"), F.col("__n").alias("change"))
    exit_ = F.struct((F.col("__us") + seconds * MICROS).alias("us"), F.lit(1).alias("leaves"), (-F.col("__n")).alias("change"))
    steps = counted.select(*own, ts, F.explode(F.array(entry, exit_)).alias("s")).select(*own, ts, "s.*")
    summed = running_sum(steps, own, ["us", "leaves"], "change", name)
    return summed.filter("leaves = 0").drop("us", "leaves", "change", "__all")


def _with_previous(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Placed rows with ``prev_<c>`` of the row before."""
    packed = F.struct(*[F.col(c) for c in columns])
    inside = rows.withColumn("__prev", F.lag(packed).over(Window.partitionBy(*keys, "__part").orderBy("__at")))
    # The last row of the partitions before: the one that stands latest.
    last = carried(rows, keys, F.struct("__at", packed.alias("row")), F.max, "__before")
    joined = inside.join(last, [*keys, "__part"], "left")
    return joined.select(
        *rows.columns,
        *[F.when(F.col("__prev").isNull(), F.col(f"__before.row.{c}")).otherwise(F.col(f"__prev.{c}")).alias(f"prev_{c}") for c in columns],
    )


def chunked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``prev_<c>`` of the row before, per key and in ``order``, which has to be total."""
    keys = list(keys)
    return _with_previous(placed(df, keys, order), keys, columns).drop("__at", "__part")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_s: int, name: str = "session") -> DataFrame:
    """Number the runs of a key whose rows follow each other in less than ``gap_s``.

    The session id is the start time of the run in micros: the latest time
    that began a run, so far. Rows are placed once, in order of time and, for
    equal times, of their contents, so that ranges can part them.
    """
    keys = list(keys)
    timed = df.withColumn("__us", micros(ts)).withColumn("__tie", F.xxhash64(*df.columns))
    rows = _with_previous(placed(timed, keys, ["__us", "__tie"]), keys, ["__us"])
    begins = F.col("prev___us").isNull() | (F.col("__us") - F.col("prev___us") >= gap_s * MICROS)
    rows = rows.withColumn("__start", F.when(begins, F.col("__us")))
    inside = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = carried(rows, keys, F.col("__start"), F.max, "__carry")
    seen = rows.withColumn("__seen", F.max("__start").over(inside)).join(before, [*keys, "__part"])
    return seen.select(*df.columns, F.coalesce("__seen", "__carry").alias(name))


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], strict: bool = False
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of its key whose ``on`` is not later (``strict``: earlier).

    Both sides are ranged together by (key, on), so a hot key is as many
    ranges as it needs; what a range needs of those before it is one row per
    key. Equal ``on`` on the right: the row with the largest ``columns``. Keys
    hold no nulls; rows without a match keep nulls; a left row without ``on``
    has none.
    """
    keys = list(keys)
    mine, theirs = F.struct(*left.columns), F.struct(*columns)
    late, early = F.lit(1), F.lit(0)
    asked = left.select(*keys, on, (early if strict else late).alias("__side"), mine.alias("__left"), F.xxhash64(*left.columns).alias("__tie"))
    given = right.where(F.col(on).isNotNull()).select(*keys, on, (late if strict else early).alias("__side"), theirs.alias("__right"))
    both = asked.unionByName(given, allowMissingColumns=True)
    rows = placed(both, keys, [on, "__side", "__right", "__tie"])
    inside = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = carried(rows, keys, F.when(F.col("__right").isNotNull(), F.struct("__at", "__right")), F.max, "__before")
    seen = rows.withColumn("__last", F.last("__right", ignorenulls=True).over(inside)).where("__left IS NOT NULL")
    joined = seen.join(before, [*keys, "__part"], "left").withColumn("__last", F.coalesce("__last", "__before.__right"))
    return joined.select("__left.*", *[F.col(f"__last.{c}").alias(c) for c in columns])


def _next_index(us: np.ndarray, wait: int) -> np.ndarray:
    return np.searchsorted(us, us + wait, side="left")


def _exits(us: np.ndarray, wait: int) -> np.ndarray:
    """For a fire at each time: when may the key fire again after the chunk's last fire?"""
    n = len(us)
    hop = np.append(_next_index(us, wait), n)
    last = np.append(np.arange(n), n)
    # Pointer doubling: follow the chain of fires to its last member.
    while True:
        inside = hop[:n] < n
        if not inside.any():
            break
        step = hop.copy()
        last[:n] = np.where(inside, last[np.minimum(step[:n], n)], last[:n])
        hop[:n] = np.where(inside, step[np.minimum(step[:n], n)], step[:n])
    return us[last[:n]] + wait


def _followed_by_doubling(tables: DataFrame, roots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __part, __entry) of the ranges that are entered on the way from ``roots`` (__id), the first rows of keys.

    A row of ``tables`` (keys, __part, __upto, __exit, __id) leads to the row
    where the key is entered next: the first whose ``__upto`` is not before its
    exit. Those steps are composed with themselves, so after k rounds a row
    knows where 2^k steps lead, until no root has a step left; then the way is
    filled in, from the longest steps to the single ones. Every round is a join
    on ids, which no key can make hot on the side that is looked up.
    """
    ends = tables.select(*keys, "__id", "__exit", (-F.col("__exit")).alias("__on"))
    marks = tables.select(*keys, F.col("__id").alias("__next"), (-F.col("__upto")).alias("__on"))
    step = asof_join(ends, marks, keys, "__on", ["__next"]).where("__next IS NOT NULL")
    steps = [stored(step.select("__id", F.col("__exit").alias("__entry"), "__next"), "steps")]
    while not steps[-1].join(roots, "__id", "left_semi").isEmpty():
        last = steps[-1]
        ahead = last.select(F.col("__id").alias("__next"), F.col("__entry").alias("__entry2"), F.col("__next").alias("__next2"))
        twice = last.join(ahead, "__next").select("__id", F.col("__entry2").alias("__entry"), F.col("__next2").alias("__next"))
        steps.append(stored(twice, "steps"))
    way = roots.select("__id", F.lit(np.iinfo(np.int64).min).alias("__entry"))
    for jump in reversed(steps):
        led = way.select("__id").join(jump, "__id").select(F.col("__next").alias("__id"), "__entry")
        way = stored(way.unionByName(led), "way")
    return way.join(tables, "__id").select(*keys, "__part", "__entry")


def cooldown_fires(df: DataFrame, keys: Sequence[str], ts: str, cooldown_s: int, followed: int = FOLLOWED) -> DataFrame:
    """Times at which a key fires when it must rest ``cooldown_s`` after each fire.

    Whether a row fires depends on the fire before it. Distinct times are
    ranged over partitions by count. For each key and partition a table says,
    for every time it may be entered with, when it is left. A key whose tables
    hold at most ``followed`` rows has them followed in order by one task. A
    denser key, with many times inside one cooldown, has them followed by
    doubling, which never brings its rows together. Either way gives each
    partition its entry, and each is then replayed from there.
    """
    if not keys:
        return cooldown_fires(df.withColumn("__all", F.lit(0)), ["__all"], ts, cooldown_s, followed).drop("__all")
    keys = list(keys)
    wait = cooldown_s * MICROS
    times = placed(df.select(*keys, micros(ts).alias("__us")).distinct(), keys, ["__us"]).drop("__at")
    types = dict(times.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)

    def fill(pdf: pd.DataFrame, rows: dict) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    def part_table(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["__us"].to_numpy(dtype=np.int64))
        exits = _exits(us, wait)
        # Fires before this partition lie before its first time, so it is entered at most a cooldown later.
        reach = min(int(np.searchsorted(us, us[0] + wait, side="left")) + 1, len(us))
        changes = np.append(exits[:reach][1:] != exits[:reach][:-1], True)
        steps = {"__upto": us[:reach][changes], "__exit": exits[:reach][changes]}
        return fill(pdf, {"__part": np.full(len(steps["__upto"]), int(pdf["__part"].iloc[0])), **steps})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = np.iinfo(np.int64).min
        parts, entries = [], []
        for part, table in pdf.sort_values("__upto").groupby("__part", sort=True):
            at = int(np.searchsorted(table["__upto"].to_numpy(), entry, side="left"))
            if at < len(table):
                parts.append(int(part))
                entries.append(entry)
                entry = int(table["__exit"].iloc[at])
        return fill(pdf, {"__part": parts, "__entry": entries})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(pdf["__us"].to_numpy(dtype=np.int64))
        hop = _next_index(us, wait)
        at = int(np.searchsorted(us, int(pdf["__entry"].iloc[0]), side="left"))
        fires = []
        while at < len(us):
            fires.append(int(us[at]))
            at = int(hop[at])
        return fill(pdf, {"__us": np.array(fires, dtype=np.int64)})

    tables = times.groupBy(*keys, "__part").applyInPandas(part_table, f"{head}__part long, __upto long, __exit long")
    tables = stored(tables.withColumn("__id", F.monotonically_increasing_id()), "tables")
    sizes = tables.groupBy(*keys).agg(F.count("*").alias("__rows"), F.min_by("__id", "__upto").alias("__id"))
    dense = stored(sizes.where(F.col("__rows") > followed), "dense")
    if dense.isEmpty():
        entries = tables.groupBy(*keys).applyInPandas(follow, f"{head}__part long, __entry long")
    else:
        sparse = tables.join(dense.select(*keys), keys, "left_anti")
        entries = sparse.groupBy(*keys).applyInPandas(follow, f"{head}__part long, __entry long")
        hot = stored(tables.join(dense.select(*keys), keys, "left_semi"), "hot")
        entries = entries.unionByName(_followed_by_doubling(hot, dense.select("__id"), keys))
    entered = times.join(entries, [*keys, "__part"])
    fires = entered.groupBy(*keys, "__part").applyInPandas(replay, f"{head}__us long")
    return fires.select(*keys, from_micros(F.col("__us")).alias(ts))
