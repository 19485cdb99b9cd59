"""Streams against their batch twins on the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import alerts as B
from tallyloom.operators.windows import sliding_count
from tallyloom.queries.streams import run_once
from tallyloom.sources import streams as S
from tallyloom.streaming import alerts as A
from tallyloom.streaming import logs as L

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for _ in range(600):
        at = START + dt.timedelta(seconds=rng.randrange(0, 7200), milliseconds=rng.randrange(1000))
        out.append((at, rng.choice(["API_BE", "DB"]), rng.choice(["ERROR", "CRITICAL", "INFO", "WARN"]), f"m{rng.randrange(3)}"))
    # A last row far ahead closes every window before it.
    return sorted(out) + [(START + dt.timedelta(days=2), "none", "INFO", "end")]


SCHEMA = "timestamp timestamp_ntz, service string, level string, message string"


@pytest.fixture(scope="module")
def feed(spark, rows, tmp_path_factory):
    """The rows as a folder of files in time order, and as a table."""
    folder = tmp_path_factory.mktemp("feed")
    for i in range(0, len(rows), 150):
        spark.createDataFrame(rows[i : i + 150], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    table = spark.createDataFrame(rows, SCHEMA)

    def stream():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return source.withColumn("container", F.lit("c"))

    return table.withColumn("container", F.lit("c")), stream


def seconds(rows, column="at"):
    return sorted((r[column].replace(tzinfo=None) - START).total_seconds() for r in rows)


def test_hourly_trend(spark, feed):
    table, stream = feed
    closed = run_once(L.tumbling_trend(stream()), spark, "t-trend").collect()
    batch = L.tumbling_trend(table).filter(F.col("bucket") < F.lit(START + dt.timedelta(days=1))).collect()
    assert sorted(map(tuple, closed)) == sorted(map(tuple, batch)) and len(closed) == 2


def test_dedupe(spark, feed):
    table, stream = feed
    twice = stream().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    got = run_once(L.dedupe_logs(twice.withColumn("timestamp", F.col("timestamp").cast("timestamp"))), spark, "t-dedupe")
    assert got.count() == L.dedupe_logs(table).count() == table.select("timestamp", "message").distinct().count()


def test_critical_alerts(spark, feed):
    table, stream = feed
    got = run_once(A.critical_alert_stream(stream(), 60), spark, "t-critical").collect()
    whole = table.withColumn("timestamp", B.to_second()).filter(F.col("level").isin("ERROR", "CRITICAL"))
    want = B.critical_alerts(whole, 60, min_level="ERROR").collect()
    assert {(r["message"], s) for r in got for s in [(r["at"] - START).total_seconds()]} == {
        (r["message"], (r["timestamp"] - START).total_seconds()) for r in want
    }


def test_recovery(spark, feed):
    table, stream = feed
    got = run_once(A.recovery_stream(stream()), spark, "t-recovery").collect()
    errors = table.filter(F.col("level").isin("ERROR", "CRITICAL"))
    want = B.recovery_decisions(errors).collect()
    assert sorted((r["service"], r["action"], r["errors"], s) for r in got for s in [(r["at"] - START).total_seconds()]) == sorted(
        (r["service"], r["action"], r["errors"], (r["at"] - START).total_seconds()) for r in want
    )
    assert {r["action"] for r in want} == {"restart", "restart_limit"}


def test_rate_limit(spark, feed):
    table, stream = feed
    rules = dict(window_s=300, max_sent=3, open_s=600)
    got = run_once(A.rate_limit_stream(stream(), **rules), spark, "t-limit").collect()
    want = B.rate_limit(table.filter(F.col("level").isin("ERROR", "CRITICAL")), ["service"], **rules).collect()

    def answers(rows):
        return sorted((r["service"], (r["at"] - START).total_seconds(), r["sent"], r["rate_limited"], r["circuit_open"]) for r in rows)

    assert answers(got) == answers(want) and {r["rate_limited"] for r in want} == {0, 1}


def test_sliding_counts(spark, feed):
    """Against the batch twin on whole seconds, service by service; windows hang over the batches' ends."""
    table, stream = feed
    got = run_once(A.sliding_count_stream(stream(), window_s=600), spark, "t-sliding").collect()
    errors = table.filter(F.col("level").isin("ERROR", "CRITICAL")).withColumn("timestamp", B.to_second())
    want = sliding_count(errors, ["service"], "timestamp", 600).collect()
    assert sorted((r["service"], (r["at"] - START).total_seconds(), r["in_window"]) for r in got) == sorted(
        (r["service"], (r["timestamp"] - START).total_seconds(), r["in_window"]) for r in want
    )
    assert len(got) > 200 and max(r["in_window"] for r in got) > 10


def test_a_busy_service_is_counted_by_many_tasks(spark, feed):
    """Slots of a service's time are keys of their own, so one service's seconds do not pass one task."""
    _, stream = feed
    one = stream().withColumn("service", F.lit("API_BE"))
    out = A.sliding_count_stream(one, window_s=600)
    assert "slot" in out._jdf.queryExecution().analyzed().toString()
    got = run_once(out, spark, "t-busy").collect()
    errors = sorted((r["at"].replace(tzinfo=None) - START).total_seconds() for r in got)
    assert errors[0] < A.SLOT_S <= errors[-1] and len(got) == len(set(errors))


def test_empty_windows_are_forgotten(spark, tmp_path):
    """Once a key's window has run empty nothing of it stays in the state, and it starts anew."""
    feed = tmp_path / "feed"
    early = [(START + dt.timedelta(seconds=i % 50), f"s{i % 20}", "ERROR", "m") for i in range(400)]
    later = [(START + dt.timedelta(days=1, hours=1), "s1", "ERROR", "m")]
    for batch in (early, [(START + dt.timedelta(days=1), "s", "INFO", "a")], later, [(START + dt.timedelta(days=2), "s", "INFO", "b")], [(START + dt.timedelta(days=3), "s", "INFO", "c")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))
    query = S.micro_batch_sink(A.sliding_count_stream(source, window_s=60), S.store_batches(str(tmp_path / "out")), str(tmp_path / "state"))
    query.awaitTermination()
    last = [op for op in query.recentProgress[-1]["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert last and last[0]["numRowsTotal"] <= 2
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).filter("service = 's1'").orderBy("at").collect()
    assert rows[-1]["in_window"] == 1 and rows[-2]["in_window"] == 20


def test_shipper_message_shapes(spark):
    schema = S.SHIPPER_SCHEMA
    path = "/var/lib/docker/containers/" + "ab" * 32 + "/x-json.log"
    lines = [
        ('{"@timestamp":"2024-01-01T00:00:00Z","message":"x","container":{"name":"/fastapi-main"}}',),
        ('{"message":"error","docker":{"container":{"name":"kafka-main"}}}',),
        ('{"message":"x","fields":{"container":"redis-main"}}',),
        ('{"message":"x","log":{"file":{"path":"%s"}}}' % path,),
        ('{"message":"from postgres-main now"}',),
        ("not json",),
    ]
    names = spark.createDataFrame([("ab" * 32, "mongo-main")], "container_id string, name string")
    got = L.shape_logs(S.decode_json(spark.createDataFrame(lines, "raw string"), schema), names).collect()
    assert sorted((r["container"], r["service"], r["level"]) for r in got if r["container"]) == [
        ("fastapi-main", "API_BE", "INFO"), ("kafka-main", "Kafka", "ERROR"), ("mongo-main", "DB", "INFO"),
        ("postgres-main", "DB", "INFO"), ("redis-main", "DB", "INFO"),
    ]


def test_late_rows_are_counted(spark):
    df = spark.createDataFrame([(START,), (START + dt.timedelta(hours=1),)], "timestamp timestamp_ntz")
    kept, late = L.split_late(df, F.lit(START + dt.timedelta(minutes=1)).cast("timestamp_ntz"))
    assert kept.count() == 1 and late.first()["late_rows"] == 1


def test_silent_keys_are_forgotten(spark, tmp_path):
    """Many messages once, then a row far ahead: what they left in the state goes."""
    feed = tmp_path / "feed"
    early = [(START + dt.timedelta(seconds=i), "s", "ERROR", f"message {i}") for i in range(200)]
    for batch in (early, [(START + dt.timedelta(days=1), "s", "INFO", "a")], [(START + dt.timedelta(days=2), "s", "INFO", "b")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))
    query = S.micro_batch_sink(A.critical_alert_stream(source, 60), S.store_batches(str(tmp_path / "out")), str(tmp_path / "state"))
    query.awaitTermination()
    ops = [
        op
        for p in query.recentProgress
        for op in p["stateOperators"]
        if op["operatorName"].startswith("transformWithState")
    ]
    written, removed = (sum(op[m] for op in ops) for m in ("numRowsUpdated", "numRowsRemoved"))
    assert written >= 400 and removed == 400  # two values per message
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).count() == 200


def test_late_rows_are_counted_in_the_stream(spark, tmp_path):
    """A row a day behind what the watermark has seen is dropped, and counted."""
    feed = tmp_path / "feed"
    day = dt.timedelta(days=1)
    for batch in ([(START + 2 * day, "s", "ERROR", "a")], [(START + 3 * day, "s", "ERROR", "b")], [(START, "s", "ERROR", "late")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(feed))
    query = S.micro_batch_sink(L.tumbling_trend(source), S.store_batches(str(tmp_path / "out")), str(tmp_path / "state"))
    query.awaitTermination()
    assert S.dropped_late(query) == 1


def test_flushes_are_dealt_out(spark, tmp_path):
    """A large batch in one partition is flushed by several tasks, a small one in few files; none holds more than is allowed."""
    write = S.store_batches(str(tmp_path), documents=10)
    write(spark.range(0, 4_000, 1, 1), 0)
    write(spark.range(0, 35, 1, 1), 1)
    names = {batch: sorted(f.name for f in (tmp_path / f"batch={batch}").glob("part-*")) for batch in (0, 1)}
    assert len({name.split("-")[1] for name in names[0]}) > 1 and len(names[1]) == 4
    rows = spark.read.parquet(str(tmp_path)).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in rows) == 10 and sum(r["count"] for r in rows) == 4_035
