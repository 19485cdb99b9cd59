"""Tables cut into parts, with a list of versions that names the files of every part.

A write touches the parts its rows fall into: it reads and rewrites those and
leaves the files of all others where they are. The new version is one small
file, written when the parts are complete, so a reader finds the whole old
state or the whole new one.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.session import scratch_path

# Slices of a part that is sorted as it is written, and the shuffled bytes that one task sorts.
SLICES, SORTED_BYTES, ADVISORY = 16, "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes"

LISTED = "batch string, streams map<string,bigint>, schema string, parts map<string,string>, version long"

Rule = Callable[[DataFrame, DataFrame], DataFrame]

# What a write is known by: a name of its own, or a stream's name and the number of its batch.
Batch = str | tuple[str, int]


class VersionTaken(RuntimeError):
    """Another writer published the next version first; read again and repeat the write."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    parts: Mapping[str, str]  # part -> folder below the root
    streams: Mapping[str, int]  # stream -> number of the last batch that is in


def bucket(keys: Sequence[str], count: int) -> Column:
    """One of ``count`` parts by the hash of the key."""
    return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("string")


def day(ts: str) -> Column:
    """One part a day; rows without a time share one."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("none"))


class PartTable:
    """A table below ``root`` whose rows fall into parts by ``part``, a column of plain names (digits, dates).

    The driver holds one entry per part, so their number is what the caller
    chooses it to be (buckets) or what time brings (days). One writer at a
    time: a second one that starts from the same version is told apart when it
    publishes, and has to repeat its write.
    """

    def __init__(self, spark: SparkSession, root: str, part: Column, order: Sequence[str] = ()):
        """Rows of a file are sorted by ``order``, so that a filter on it skips most of the file."""
        self.spark, self.root, self.part, self.order = spark, root.rstrip("/"), part, tuple(order)

    # --- versions ---

    def versions(self) -> DataFrame:
        """(batch, streams, schema, parts, version), a row per version."""
        return self.spark.read.schema(LISTED).option("basePath", f"{self.root}/versions").parquet(f"{self.root}/versions")

    def current(self, number: int | None = None) -> Version:
        """The version of this number, by default the latest."""
        listed = self.versions()
        if number is None:
            number = listed.agg(F.max("version")).first()[0]
        row = listed.where(F.col("version") == number).first()
        return Version(number, StructType.fromJson(json.loads(row.schema)), dict(row.parts), dict(row.streams))

    def applied(self, batch: Batch) -> bool:
        """Whether this batch is in already: a name in any version, a number up to the last of its stream."""
        if isinstance(batch, tuple):
            return self.current().streams.get(batch[0], -1) >= batch[1]
        return not self.versions().where(F.col("batch") == batch).isEmpty()

    def _publish(self, number: int, batch: Batch | None, schema: StructType, parts: Mapping[str, str], streams: Mapping[str, int] | None = None) -> int:
        name, streams = batch, dict(streams or {})
        if isinstance(batch, tuple):
            name, streams = None, streams | {batch[0]: batch[1]}
        row = self.spark.createDataFrame([(name, streams, schema.json(), dict(parts))], LISTED.rsplit(",", 1)[0])
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/versions/version={number}")
        except AnalysisException as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise VersionTaken(f"version {number} of {self.root}") from error
            raise
        return number

    # --- rows ---

    def _rows(self, schema: StructType, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, parts: Sequence[str] | None = None, number: int | None = None) -> DataFrame:
        """The rows of a version, of all parts or of those named; files of other parts are not listed."""
        now = self.current(number)
        return self._rows(now.schema, [f for p, f in now.parts.items() if parts is None or p in set(parts)])

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the parts that ``keys``, a frame with the key columns, falls into."""
        return self.read(self._parts_of(self._as_stored(keys, self.current().schema)))

    def _as_stored(self, df: DataFrame, schema: StructType) -> DataFrame:
        """Columns in the types they are stored in, so that equal keys hash alike."""
        kinds = {f.name: f.dataType for f in schema}
        return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])

    def _parts_of(self, df: DataFrame) -> list[str]:
        return [r[0] for r in df.select(self.part.alias("p")).distinct().collect()]

    def _write(self, df: DataFrame, number: int) -> dict[str, str]:
        """Write rows as files by part; part -> folder of those that have any.

        Rebalancing keeps a part's files together and cuts a large part into
        tasks of the advisory size. Rows that are sorted have to fit a task, and
        shuffled bytes say little of that: alike rows shrink far. So a part
        comes in slices, which no reader of the shuffle has to take at once,
        and the advisory size is small while it is written.
        """
        folder = f"data/{number:08d}-{uuid.uuid4().hex}"
        marked, conf = df.withColumn("__part", self.part), df.sparkSession.conf
        if not self.order:
            marked.hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{self.root}/{folder}")
        else:
            sliced = marked.withColumn("__slice", F.pmod(F.xxhash64(*self.order), F.lit(SLICES))).hint("rebalance", "__part", "__slice")
            advised = conf.get(ADVISORY)
            conf.set(ADVISORY, SORTED_BYTES)
            try:
                sliced.sortWithinPartitions("__part", *self.order).drop("__slice").write.partitionBy("__part").parquet(f"{self.root}/{folder}")
            finally:
                conf.set(ADVISORY, advised)
        written = self.spark.read.schema(StructType([*df.schema]).add("__part", "string")).parquet(f"{self.root}/{folder}")
        return {r[0]: f"{folder}/__part={r[0]}" for r in written.select("__part").distinct().collect()}

    # --- writes ---

    def create(self, df: DataFrame, batch: Batch | None = None) -> int:
        """The first version."""
        return self._publish(1, batch, df.schema, self._write(df, 1))

    def apply(self, delta: DataFrame, rule: Rule, batch: Batch | None = None) -> int:
        """Replace the parts that ``delta`` falls into by ``rule(their rows, delta)``; the number of the version.

        A ``batch`` that is in already changes nothing, whoever repeats it; a
        stream's batches come in the order of their numbers. The rule may add columns; rows of other parts read null
        there.
        """
        now = self.current()
        if batch is not None and self.applied(batch):
            return now.number
        # Read twice, so stored: what it was made from may have moved on.
        path = scratch_path(self.spark, "delta")
        self._as_stored(delta, now.schema).write.parquet(path)
        fresh = self.spark.read.schema(self._as_stored(delta, now.schema).schema).parquet(path)
        touched = set(self._parts_of(fresh))
        old = self._rows(now.schema, [f for p, f in now.parts.items() if p in touched])
        return self._replace(now, touched, rule(old, fresh), batch)

    def rewrite(self, parts: Sequence[str], change: Callable[[DataFrame], DataFrame], batch: Batch | None = None) -> int:
        """Replace the named parts by ``change(their rows)``; a part left without rows is gone."""
        now = self.current()
        held = [p for p in parts if p in now.parts]
        return self._replace(now, set(held), change(self._rows(now.schema, [now.parts[p] for p in held])), batch)

    def drop(self, parts: Sequence[str], batch: Batch | None = None) -> int:
        """A version without the named parts; no rows are read or written."""
        now = self.current()
        kept = {p: f for p, f in now.parts.items() if p not in set(parts)}
        return self._publish(now.number + 1, batch, now.schema, kept, now.streams)

    def keep_since(self, ts: str, cutoff: dt.datetime) -> int:
        """For a table cut by ``day(ts)``: only rows from ``cutoff`` on stay.

        Days that end before it are dropped by their names, the day it falls
        into is rewritten, later days are not read.
        """
        now, boundary = self.current(), cutoff.strftime("%Y-%m-%d")
        old = {p for p in now.parts if p < boundary or p == "none"}
        if cutoff.time() == dt.time() or boundary not in now.parts:
            return self.drop(sorted(old))
        rows = self._rows(now.schema, [now.parts[boundary]])
        return self._replace(now, old | {boundary}, rows.filter(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz")), None)

    def _replace(self, now: Version, touched: set[str], rows: DataFrame, batch: Batch | None) -> int:
        number = now.number + 1
        schema = StructType([*now.schema, *[f for f in rows.schema if f.name not in now.schema.names]])
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        written = self._write(rows, number)
        if not set(written) <= touched:
            raise ValueError("a rule may only return rows of the parts it was given")
        return self._publish(number, batch, schema, {p: f for p, f in now.parts.items() if p not in touched} | written, now.streams)

    def expire(self, keep: int = 2) -> int:
        """Delete part folders that none of the last ``keep`` versions names; how many went.

        Their lists go too, but for the last ``keep`` and those of named
        batches, which tell what was applied; of streams the last list knows.
        """
        listed = [(r.version, r.batch, dict(r.parts)) for r in self.versions().collect()]
        last = sorted(v for v, _, _ in listed)[-keep:]
        live = {f for v, _, parts in listed if v in last for f in parts.values()}
        gone = {f for _, _, parts in listed for f in parts.values()} - live
        lists = [f"versions/version={v}" for v, batch, _ in listed if v not in last and batch is None]
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        for folder in [*gone, *lists]:
            files.delete(context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"), True)
        return len(gone)
