"""Stored tables, the number ledger, keyed streams, pages and postings."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import aggregates as A
from tallyloom.operators import keyed as K
from tallyloom.operators import paging as G
from tallyloom.operators import postings as N
from tallyloom.operators.sequence import SequenceLedger, assign_reserved
from tallyloom.plans import domain as D
from tallyloom.sources.versioned import SORTED_BYTES, PartTable, VersionTaken, bucket, day
from tallyloom.streaming import keyed as T

START = dt.datetime(2024, 1, 1)
ROWS = "id long, x string, y int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    out = PartTable(spark, str(tmp_path / "t"), bucket(["id"], 8))
    out.create(spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], ROWS))
    return out


def full(old, new):
    return K.upsert_full(old, new, ["id"])


def test_only_touched_parts_are_rewritten(spark, table):
    before = table.current()
    delta = spark.createDataFrame([(3, "new", None), (1000, "more", 1)], ROWS)
    touched = {r[0] for r in delta.select(bucket(["id"], 8)).collect()}
    assert table.apply(delta, full) == 2
    after = table.current()
    assert {p for p, f in after.parts.items() if before.parts.get(p) != f} == touched and len(touched) <= 2 < len(after.parts)
    want = K.upsert_full(spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], ROWS), delta, ["id"])
    assert rows_of(table.read()) == rows_of(want)
    # The version before is still there, whole.
    assert rows_of(table.read(number=1)) == [(i, f"v{i}", i) for i in sorted(range(100), key=lambda i: repr((i, f"v{i}", i)))]


def test_a_read_by_key_lists_only_its_parts(spark, table):
    found = table.read_keys(spark.createDataFrame([(3,)], "id int"))
    assert found.filter("id = 3").count() == 1 and len(set(re.findall(r"__part=(\d+)", "".join(found.inputFiles())))) == 1


def test_a_repeated_batch_changes_nothing(spark, table):
    counts = spark.createDataFrame([(1, 5), (2, 7)], "id long, n long")
    rule = lambda old, new: K.add_counts(old, new, ["id"], "y")
    assert table.apply(counts, rule, batch="b1") == 2
    assert table.apply(counts, rule, batch="b1") == 2 and table.current().number == 2
    assert table.apply(counts, rule, batch="b2") == 3
    assert {r.id: r.y for r in table.read().filter("id < 4").collect()} == {0: 0, 1: 11, 2: 16, 3: 3}


def test_of_two_writers_one_is_told(spark, table):
    now = table.current()
    table.apply(spark.createDataFrame([(1, "a", 1)], ROWS), full)
    with pytest.raises(VersionTaken):
        table._publish(now.number + 1, None, now.schema, now.parts)
    assert table.current().number == 2


def test_unfinished_writes_are_not_read(spark, table, tmp_path):
    table._write(spark.createDataFrame([(1, "lost", 1)], ROWS), 2)
    assert table.current().number == 1 and table.read().filter("x = 'lost'").isEmpty()


def test_columns_may_be_added_and_parts_may_empty(spark, table):
    table.apply(spark.createDataFrame([(1, 2.5)], "id long, z double"), full)
    assert {r.id: r.z for r in table.read().filter("id < 3").collect()} == {0: None, 1: 2.5, 2: None}
    assert table.read().columns == ["id", "x", "y", "z"]
    every = table.read().select("id")
    table.apply(every, lambda old, new: old.join(new, "id", "left_anti"))
    assert table.current().parts == {} and table.read().count() == 0
    table.apply(spark.createDataFrame([(7, "x", 1)], ROWS), full)
    assert [tuple(r) for r in table.read().collect()] == [(7, "x", 1, None)]


def test_empty_tables_and_deltas(spark, tmp_path):
    empty = PartTable(spark, str(tmp_path / "e"), bucket(["id"], 4))
    empty.create(spark.createDataFrame([], ROWS))
    assert empty.read().count() == 0
    assert empty.apply(spark.createDataFrame([], ROWS), full, batch="none") == 2 and empty.applied("none")
    empty.apply(spark.createDataFrame([(1, None, None)], ROWS), full)
    assert [tuple(r) for r in empty.read().collect()] == [(1, None, None)]


def test_a_rule_stays_within_its_parts(spark, table):
    with pytest.raises(ValueError):
        table.apply(spark.createDataFrame([(1, "a", 1)], ROWS), lambda old, new: spark.range(50).select("id", F.lit("x").alias("x"), F.lit(1).alias("y")))


def test_expired_folders_go(spark, table):
    for i in range(4):
        table.apply(spark.createDataFrame([(1, f"a{i}", i)], ROWS), full, batch=f"b{i}")
    assert table.expire(keep=1) == 4
    assert table.read().count() == 100 and table.applied("b0")
    assert table.apply(spark.createDataFrame([(1, "x", 9)], ROWS), full, batch="b0") == 5


def test_streams_are_known_by_their_last_batch(spark, table):
    """A long stream leaves no list behind for every batch."""
    for i in range(3):
        assert table.apply(spark.createDataFrame([(1, f"s{i}", i)], ROWS), full, batch=("s", i)) == i + 2
    assert table.apply(spark.createDataFrame([(1, "other", 7)], ROWS), full, batch=("t", 0)) == 5
    table.expire(keep=1)
    assert table.versions().count() == 1 and table.current().streams == {"s": 2, "t": 0}
    assert table.apply(spark.createDataFrame([(1, "again", 9)], ROWS), full, batch=("s", 1)) == 5
    assert table.applied(("s", 2)) and not table.applied(("s", 3)) and not table.applied(("u", 0))
    assert table.read().filter("id = 1").first()["x"] == "other"


def test_whole_days_go_by_name(spark, tmp_path):
    at = (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts")
    rows = spark.range(240).select("id", at).unionByName(spark.createDataFrame([(999, None)], "id long, ts timestamp_ntz"))
    table = PartTable(spark, str(tmp_path / "d"), day("ts"))
    table.create(rows)
    before = table.current().parts
    table.keep_since("ts", START + dt.timedelta(days=4, hours=7))
    after = table.current().parts
    assert sorted(r.id for r in table.read().collect()) == list(range(4 * 24 + 7, 240))
    # Kept days are the files they were, the boundary's is new, earlier ones and the one without a time are gone.
    assert sorted(after) == [f"2024-01-{d:02}" for d in range(5, 11)]
    assert [p for p in after if after[p] != before[p]] == ["2024-01-05"]
    table.keep_since("ts", START + dt.timedelta(days=6))
    assert sorted(r.id for r in table.read().collect()) == list(range(6 * 24, 240))
    assert all(table.current().parts[p] == after[p] for p in table.current().parts)


# --- numbers -------------------------------------------------------------------


def test_ledger(spark, tmp_path):
    ledger = SequenceLedger(spark, str(tmp_path / "l"))
    ledger.create(spark.createDataFrame([("a", 40)], "brand string, last_seq int"), "brand")

    def load(batch, rows):
        df = spark.createDataFrame(rows, "brand string, code int").repartition(3)
        return {(r.brand, r.code): r.seq for r in assign_reserved(df, ["code"], "brand", ledger, batch).collect()}

    one = [("a", i) for i in range(5)] + [("b", i) for i in range(3)]
    two = [("a", 100 + i) for i in range(4)] + [("c", 0)]
    first, second = load("one", one), load("two", two)
    assert load("one", one) == first and load("two", two) == second
    both = {**first, **second}
    assert sorted(n for (brand, _), n in both.items() if brand == "a") == list(range(41, 50))
    assert sorted(n for (brand, _), n in both.items() if brand == "b") == [1, 2, 3] and both["c", 0] == 1
    with pytest.raises(ValueError):
        load("one", one[1:])
    with pytest.raises(RuntimeError):  # two batches that start from the same state
        entries = SequenceLedger.entries
        ledger.entries = lambda: entries(ledger).where("entry < 1")
        ledger.reserve("three", spark.createDataFrame([("a", 2)], "brand string, n long"), "brand")


# --- streams -------------------------------------------------------------------


def test_replayed_batches_change_nothing(spark, tmp_path):
    rng = random.Random(6)
    events = [(i, f"k{rng.randrange(9)}", rng.choice(["on", "off"]), START + dt.timedelta(seconds=rng.randrange(500))) for i in range(300)]
    schema = "event_id long, k string, action string, at timestamp_ntz"
    whole = spark.createDataFrame(events, schema)
    feed = str(tmp_path / "feed")
    for i in range(0, 300, 100):
        spark.createDataFrame(events[i : i + 100], schema).coalesce(1).write.mode("append").parquet(feed)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)

    def new(name, rows):
        out = PartTable(spark, str(tmp_path / name), bucket(["k"], 4))
        out.create(rows)
        return out

    touched = new("touched", whole.select("k", "at").limit(0))
    switched = new("switched", whole.select("k", "action", "at", "event_id").limit(0))
    counted = new("counted", spark.createDataFrame([("k1", 10), ("k2", None), ("other", 5)], "k string, view_count long"))
    for run in range(2):
        T.touch_stream(stream(), touched, ["k"], "t", str(tmp_path / f"t{run}")).awaitTermination()
        T.toggle_stream(stream(), switched, ["k"], "s", str(tmp_path / f"s{run}")).awaitTermination()
        T.counter_stream(stream(), counted, ["k"], "c", str(tmp_path / f"c{run}")).awaitTermination()
        assert touched.current().number == switched.current().number == counted.current().number == 4
    assert rows_of(touched.read().select("k", "at")) == rows_of(K.touch_latest(whole, ["k"]))
    on = switched.read().filter("action = 'on'").select("k", "at")
    assert rows_of(on) == rows_of(K.toggle_state(whole, ["k"], "on").select("k", "at"))
    base = spark.createDataFrame([("k1", 10), ("k2", None), ("other", 5)], "k string, view_count long")
    assert rows_of(counted.read()) == rows_of(K.increment_counter(base, whole, ["k"]))


def test_rollups_add_up(spark, small, tmp_path):
    """Rows in any order, in any number of lots, give the rollup of them all, and its dashboard is the scan's."""
    logs = D.logs(spark, small)
    lots = [logs.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    kept = A.hourly_rollup(logs.limit(0), 256)
    for lot in lots:
        kept = A.merged_rollup(kept.unionByName(A.hourly_rollup(lot, 256)))
    assert rows_of(kept) == rows_of(A.hourly_rollup(logs, 256))
    as_of = dt.datetime(2024, 1, 25, 7)
    args = dict(hours=300, recent_hours=30, levels_listed=3, services_listed=2)
    assert rows_of(A.dashboard_from_rollup(kept, as_of, **args)) == rows_of(A.dashboard(logs, as_of, longest=256, **args))
    with pytest.raises(ValueError):
        A.dashboard_from_rollup(kept, as_of + dt.timedelta(minutes=1))


# --- pages and postings ----------------------------------------------------------


def test_a_late_page_reads_one_or_two_ranges(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(20_000).select("id", F.pmod(F.xxhash64("id"), F.lit(300)).alias("score"))
        root, order = str(tmp_path), [F.desc("score"), F.asc("id")]
        G.build_pages(rows, order, root)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    want = [r.id for r in rows.orderBy(*order).collect()]
    for number, size in ((1, 10), (1999, 10), (2000, 10), (2001, 10), (7, 1500), (14, 1500)):
        page = G.seek_page(spark, root, "id long, score long", number, size)
        assert [r.id for r in page.collect()] == want[(number - 1) * size : number * size]
        if size == 10 and number <= 2000:
            assert len(set(re.findall(r"__part=(\d+)", "".join(page.inputFiles())))) <= 2


def test_phrases(spark, tmp_path):
    texts = ["The quick, brown fox", "quick brown fox", "a brown  fox", "Quick brown foxes", None, "", "fox fox fox", "k=1 and k-1", "brown fox brown FOX"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    table = N.build_postings(docs, "id", "body", str(tmp_path), parts=8)
    for phrase in ("brown fox", "fox", "quick brown", "fox fox", "k=1", "k-1", "quick, brown", "absent", "Brown Fox Brown"):
        pattern = re.compile(r"\b" + re.escape(phrase.lower()) + r"\b", re.ASCII)
        want = [i for i, t in enumerate(texts) if t and pattern.search(t.lower())]
        assert sorted(r.doc for r in N.phrase_documents(table, phrase).collect()) == want, phrase
    found = N.phrase_documents(table, "fox")
    assert len(set(re.findall(r"__part=(\d+)", "".join(found.inputFiles())))) == 1
    with pytest.raises(ValueError):
        N.phrase_documents(table, "fox!")
    assert {r.doc: r.score for r in N.matched_words(table, ["Fox", "the", "k"]).collect()} == {0: 2, 1: 1, 2: 1, 6: 1, 7: 1, 8: 1}
    more = spark.createDataFrame([(50, "one more brown fox")], "id long, body string")
    for _ in range(2):
        N.add_documents(table, more, "id", "body", "more")
    assert 50 in {r.doc for r in N.phrase_documents(table, "brown fox").collect()} and N._of(table, ["more"]).count() == 1


def test_a_common_word_is_sorted_in_slices(spark, tmp_path):
    """Every text holds the same word: its part is cut, though all of it comes from one task in few bytes."""
    docs = spark.range(0, 400_000, 1, 1).select(F.col("id").alias("doc"), F.lit("same").alias("text"))
    table = N.build_postings(docs, "doc", "text", str(tmp_path / "postings"))
    files = table.read().groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 400_000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != SORTED_BYTES
    assert N.phrase_documents(table, "same").count() == 400_000
