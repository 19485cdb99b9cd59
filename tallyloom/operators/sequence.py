"""Order across tasks: dense numbers and running values without a single-partition window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize, stored


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows ranged over partitions by (keys, order) and sorted, with ``__part`` and ``__at``.

    Ranges are cut by counted rows, so a hot key or a burst is as many
    partitions as it needs; ``order`` should be total, since equal rows are
    not parted. Written to the shared checkpoint folder, which freezes each
    row's partition and place: ``__at`` grows by one from row to row of a
    partition.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).sortWithinPartitions(*keys, *order)
    frozen = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()))
    return frozen.withColumn("__part", F.shiftright("__at", 33))


def carried(rows: DataFrame, keys: Sequence[str], value: Column, over: Callable[[Column], Column], name: str) -> DataFrame:
    """(keys, __part, name): ``over`` of ``value`` in all partitions of the key before this one.

    One row per key and partition is ordered; ranges follow each other, so
    there are at most as many as keys and partitions together.
    """
    ends = rows.groupBy(*keys, "__part").agg(over(value).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "__part", over(F.col("__end")).over(before).alias(name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` up to and with each row of its key in ``order``; no task sees a whole key."""
    rows = placed(df, keys, order)
    inside = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = carried(rows, keys, F.col(value), F.sum, "__before")
    total = F.sum(value).over(inside)
    summed = rows.withColumn(name, total).join(before, [*keys, "__part"])
    return summed.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before", "__at", "__part")


def assign_sequence(
    df: DataFrame,
    order: Sequence[str],
    group: str | None = None,
    last_seq: DataFrame | None = None,
    name: str = "seq",
) -> DataFrame:
    """Number rows 1..n in ``order`` within ``group``, continuing after ``last_seq``.

    ``order`` has to be total (end it with a unique column), then a hot value
    spreads over partitions. Once the rows are placed, what is left works on
    one row per partition and group. ``last_seq`` has the columns (group,
    last_seq) and meets only those. What is to be added in each range is
    stored first: Spark then knows its size, and broadcasts it where that is
    small, so that the rows need not be shuffled again.
    """
    key = [group] if group else []
    rows = placed(df, key, order)
    sizes = rows.groupBy(*key, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(
        Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    if last_seq is not None:
        last = last_seq.select(group, F.col("last_seq").cast("long").alias("__last"))
        offsets = offsets.join(last, group, "left").withColumn("__before", F.col("__before") + F.coalesce("__last", F.lit(0)))
        offsets = offsets.drop("__last")
    numbered = rows.join(stored(offsets, "offsets"), [*key, "__part"])
    number: Column = F.col("__at") - F.col("__first") + F.col("__before") + 1
    return numbered.select(*df.columns, number.cast("long").alias(name))


def next_sequences(numbered: DataFrame, group: str, name: str = "seq") -> DataFrame:
    """The last number handed out per group."""
    return numbered.groupBy(group).agg(F.max(name).alias("last_seq"))


class SequenceLedger:
    """Number ranges handed out per batch and group, kept below ``root``: a retried batch gets its numbers again.

    Every entry is one folder, made only if it is not there yet: of two
    writers that start from the same state the second fails, and has to ask
    again. Entries hold a row per group of their batch.
    """

    SCHEMA = "batch string, grp string, first long, last long, entry long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.root}/entries").parquet(f"{self.root}/entries")

    def _append(self, rows: DataFrame, entry: int) -> None:
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/entries/entry={entry}")

    def create(self, last_seq: DataFrame, group: str) -> None:
        """Begin after the numbers of ``last_seq`` (group, last_seq)."""
        last = F.col("last_seq").cast("long")
        self._append(last_seq.select(F.lit(None).cast("string").alias("batch"), F.col(group).cast("string").alias("grp"), last.alias("first"), last.alias("last")), 0)

    def last(self) -> DataFrame:
        """(grp, last): the last number handed out per group."""
        return self.entries().groupBy("grp").agg(F.max("last").alias("last"))

    def reserve(self, batch: str, counts: DataFrame, group: str) -> DataFrame:
        """(group, last_seq): after which number the batch goes on, for ``counts`` (group, n)."""
        wanted = counts.select(F.col(group).cast("string").alias("grp"), F.col("n").cast("long").alias("n")).where("grp IS NOT NULL AND n > 0")
        mine = self.entries().where(F.col("batch") == batch)
        if mine.isEmpty():
            entry = self.entries().agg(F.max("entry")).first()[0] + 1
            start = F.coalesce("last", F.lit(0).cast("long"))
            ranges = wanted.join(self.last(), "grp", "left").select(F.lit(batch).alias("batch"), "grp", (start + 1).alias("first"), (start + F.col("n")).alias("last"))
            try:
                self._append(ranges, entry)
            except AnalysisException as error:
                raise RuntimeError(f"another batch took entry {entry} of {self.root}; ask again") from error
            mine = self.entries().where(F.col("batch") == batch)
        other = wanted.join(mine, "grp", "full_outer").where(~F.col("n").eqNullSafe(F.col("last") - F.col("first") + 1))
        if not other.isEmpty():
            raise ValueError(f"batch {batch} holds other rows than when its numbers were reserved")
        return mine.select(F.col("grp").alias(group), (F.col("first") - 1).alias("last_seq"))


def assign_reserved(df: DataFrame, order: Sequence[str], group: str, ledger: SequenceLedger, batch: str, name: str = "seq") -> DataFrame:
    """``assign_sequence`` with the numbers that ``ledger`` holds, or now reserves, for ``batch``.

    Groups are texts without nulls; ``order`` has to be total, then a load that
    is repeated gives every row the number it had.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    return assign_sequence(df, order, group, ledger.reserve(batch, counts, group), name)
