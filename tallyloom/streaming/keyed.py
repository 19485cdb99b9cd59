"""Keyed state kept by streams in a stored table: last touches, switches, counters.

A micro-batch is first combined to one row per key, then merged into the
parts of the table that its keys fall into. The number of the batch is
published with the version it made, so a batch that is replayed, after a
failure or from an older checkpoint, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import aggregates as A
from tallyloom.operators import keyed as K
from tallyloom.sources.streams import micro_batch_sink
from tallyloom.sources.versioned import PartTable, Rule


def into_table(
    stream: DataFrame,
    table: PartTable,
    combine: Callable[[DataFrame], DataFrame],
    rule: Rule,
    name: str,
    checkpoint: str,
    seconds: float | None = None,
) -> StreamingQuery:
    """Merge every micro-batch, combined, into ``table`` by ``rule``; ``name`` tells the batches of several streams apart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.apply(combine(batch), rule, batch=(name, batch_id))

    return micro_batch_sink(stream, write, checkpoint, seconds)


def touch_stream(events: DataFrame, table: PartTable, keys: Sequence[str], name: str, checkpoint: str, ts: str = "at") -> StreamingQuery:
    """The latest time of each key."""

    def latest(rows: DataFrame) -> DataFrame:
        return K.touch_latest(rows, keys, ts)

    return into_table(events, table, latest, lambda old, new: latest(old.unionByName(new)), name, checkpoint)


def toggle_stream(
    events: DataFrame, table: PartTable, keys: Sequence[str], name: str, checkpoint: str, action: str = "action", ts: str = "at"
) -> StreamingQuery:
    """The last action of each key; members are the rows whose action is the one that switches on."""

    def last(rows: DataFrame) -> DataFrame:
        return K.last_action(rows, keys, action, ts)

    return into_table(events, table, last, lambda old, new: last(old.unionByName(new)), name, checkpoint)


def counter_stream(
    events: DataFrame, table: PartTable, keys: Sequence[str], name: str, checkpoint: str, counter: str = "view_count"
) -> StreamingQuery:
    """counter = counter + events of the key, for the keys the table holds."""

    def counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"))

    return into_table(events, table, counts, lambda old, new: K.add_counts(old, new, keys, counter), name, checkpoint)


def rollup_stream(logs: DataFrame, table: PartTable, name: str, checkpoint: str, longest: int | None = None) -> StreamingQuery:
    """Hourly counts as they come; rows that arrive late are added to their hour, however long it is closed."""
    return into_table(logs, table, lambda rows: A.hourly_rollup(rows, longest), lambda old, new: A.merged_rollup(old.unionByName(new)), name, checkpoint)
