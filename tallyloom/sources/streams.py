"""Streaming sources and sinks. Kafka by configuration; files where there is no broker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FLUSHES = 20  # flushes that are worth a task

SHIPPER_SCHEMA = (
    "`@timestamp` string, message string, container struct<name:string>, "
    "docker struct<container:struct<name:string>>, fields struct<container:string>, "
    "log struct<file:struct<path:string>>"
)
METRIC_SCHEMA = (
    "timestamp timestamp, container string, service string, cpu_percent double, memory_percent double, "
    "memory_usage bigint, memory_limit bigint"
)


def kafka_json_stream(
    spark: SparkSession, servers: str, topic: str, schema: str, per_trigger: int | None = None
) -> DataFrame:
    """Decoded JSON values of a topic, from the latest offsets on; the text stays in ``raw``."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("failOnDataLoss", "false")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return decode_json(reader.load().select(F.col("value").cast("string").alias("raw")), schema)


def decode_json(lines: DataFrame, schema: str) -> DataFrame:
    """``raw`` JSON text to columns; a value that is no JSON object is dropped."""
    parsed = lines.withColumn("v", F.from_json("raw", schema)).filter(F.col("v").isNotNull())
    return parsed.select("v.*", "raw")


def file_json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same over a folder of JSON lines files."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode_json(lines.select(F.col("value").alias("raw")), schema)


def micro_batch_sink(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    seconds: float | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Hand every micro-batch to ``write``; by interval, or once over what is there.

    The interval plays the part of a flush timer and also fires for a quiet
    tail; how much is read at a time is set at the source (offsets or files per
    trigger), how much is flushed at a time by the writer.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def store_batches(path: str, documents: int = 0) -> Callable[[DataFrame, int], None]:
    """Writer that puts each batch into its own folder, so that a replayed batch replaces itself.

    ``documents`` is the most a flush holds: a larger batch is flushed in
    several files as it is written. Opening files is what that costs, so a
    batch of many flushes is dealt out to as many tasks as a shuffle has.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", documents).parquet(f"{path}/batch={batch_id}")

    def flush(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            most = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            tasks = min(most, kept.count() // (FLUSHES * documents))
            store(kept.repartition(tasks) if tasks > 1 else kept, batch_id)
        finally:
            kept.unpersist()

    return flush if documents else store


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def to_messages(df: DataFrame) -> DataFrame:
    """Rows as JSON values, the shape a topic takes; times keep their microseconds."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": form, "timestampNTZFormat": form}).alias("value"))


def publish_metrics(df: DataFrame, servers: str, topic: str) -> None:
    """JSON values to a topic (batch write)."""
    to_messages(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
