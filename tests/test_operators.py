"""Operators against brute force in plain Python, and properties that have to hold."""

import datetime as dt
import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import alerts as A
from tallyloom.operators import joins as J
from tallyloom.operators import keyed as K
from tallyloom.operators import offers as M
from tallyloom.operators import pages as H
from tallyloom.operators import ranking as R
from tallyloom.operators import sequence as Q
from tallyloom.operators import vector_search as V
from tallyloom.operators import windows as W
from tallyloom.plans import domain as D

START = dt.datetime(2024, 1, 1)


def moments(rng, n, span_s):
    """Bursty times with repeats, in micros after the start."""
    out = []
    while len(out) < n:
        base = rng.randrange(span_s * 1_000_000)
        out += [base + rng.randrange(2_000_000) for _ in range(rng.randrange(1, 6))]
    return out[:n]


def frame(spark, rows, schema="k string, timestamp timestamp_ntz"):
    return spark.createDataFrame([(k, START + dt.timedelta(microseconds=us)) for k, us in rows], schema)


def micros_of(value):
    return round((value - START).total_seconds() * 1_000_000)


@pytest.fixture(scope="module")
def bursts():
    rng = random.Random(5)
    rows = [("hot", us) for us in moments(rng, 1500, 20_000)]  # one key with most rows
    rows += [(f"k{i % 7}", us) for i, us in enumerate(moments(rng, 300, 20_000))]
    return rows


def by_key(rows):
    out = defaultdict(list)
    for k, us in rows:
        out[k].append(us)
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(params=["whole", "cut"])
def ranges(request, spark):
    """Small tables fall into one range; ``cut`` keeps sixteen, so that summaries are handed over."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items() if request.param == "cut" else ():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_burst_is_cut_by_rows(spark):
    """A third of the rows on one key and one hour: no range holds many more rows than its share."""
    rng = random.Random(2)
    rows = [("hot", rng.randrange(3_600_000_000)) for _ in range(4_000)]
    rows += [(f"k{i % 50}", rng.randrange(30 * 86_400_000_000)) for i in range(8_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        parts = [r["count"] for r in Q.placed(frame(spark, rows), ["k"], ["timestamp"]).groupBy("__part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(parts) == 12_000 and max(parts) <= 2 * 12_000 / 24


@pytest.mark.parametrize("cooldown", [7, 60, 900, 5000])
def test_cooldown_fires(spark, bursts, ranges, cooldown):
    want = set()
    for key, times in by_key(bursts).items():
        last = None
        for us in times:
            if last is None or us - last >= cooldown * 1_000_000:
                last = us
                want.add((key, us))
    got = W.cooldown_fires(frame(spark, bursts), ["k"], "timestamp", cooldown).collect()
    assert len(got) == len(want)
    assert {(r["k"], micros_of(r["timestamp"])) for r in got} == want


@pytest.mark.parametrize("cooldown", [30, 900])
def test_cooldown_fires_by_doubling(spark, bursts, ranges, cooldown):
    """Dense keys are followed another way, with the same result."""
    near = W.cooldown_fires(frame(spark, bursts), ["k"], "timestamp", cooldown).collect()
    doubled = W.cooldown_fires(frame(spark, bursts), ["k"], "timestamp", cooldown, followed=0).collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, doubled)) and near


def test_a_dense_key_is_never_gathered(spark, monkeypatch):
    """A million times of one key inside a cooldown, and as many spread thinly: no task is handed a key's rows together."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    plans = []
    kind = type(spark.range(1))
    group = kind.groupBy

    def watched(self, *keys):
        plans.append((self, keys))
        return group(self, *keys)

    monkeypatch.setattr(kind, "groupBy", watched)
    try:
        at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * F.when(F.col("id") < 1_000_000, 50).otherwise(5_000)).cast("timestamp_ntz")
        df = spark.range(1_100_000).select(F.lit("hot").alias("k"), at.alias("timestamp"))
        fires = W.cooldown_fires(df, ["k"], "timestamp", 60)
        # 50 s at 20,000 a second, then 200 a second up to 5,500 s; the first fire is at 0.
        got = sorted(micros_of(r["timestamp"]) for r in fires.collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got[0] == 0 and got[1] == 5_000_000_000 and all(60_000_000 <= b - a < 60_005_001 for a, b in zip(got[1:], got[2:]))
    # The first count by key is combined before it is shuffled; what is grouped by key after that holds no dense key.
    tables = [frame for frame, keys in plans if keys == ("k",) and "__upto" in frame.columns][1:]
    assert tables and all((group(frame, "k").count().agg(F.max("count")).first()[0] or 0) < 1_000 for frame in tables)


def test_cooldown_without_keys(spark, bursts, ranges):
    times = sorted({us for _, us in bursts})
    want, last = set(), None
    for us in times:
        if last is None or us - last >= 30_000_000:
            last = us
            want.add(us)
    got = W.cooldown_fires(frame(spark, bursts), [], "timestamp", 30)
    assert {micros_of(r["timestamp"]) for r in got.collect()} == want


def test_sliding_count_is_inclusive(spark):
    df = frame(spark, [("a", 0), ("a", 600_000_000), ("a", 1_200_000_001)])
    got = {micros_of(r["timestamp"]): r["in_window"] for r in W.sliding_count(df, ["k"], "timestamp", 600).collect()}
    assert got == {0: 1, 600_000_000: 2, 1_200_000_001: 1}


@pytest.mark.parametrize("window", [60, 1000])
def test_sliding_count(spark, bursts, ranges, window):
    want = {}
    for key, times in by_key(bursts).items():
        for us in times:
            want[key, us] = sum(1 for t in times if us - window * 1_000_000 <= t <= us)
    got = W.sliding_count(frame(spark, bursts), ["k"], "timestamp", window).collect()
    assert {(r["k"], micros_of(r["timestamp"])): r["in_window"] for r in got} == want


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, bursts, ranges, strict):
    rng = random.Random(9)
    right = [(k, us + rng.choice([0, 1, 10**7]), i) for i, (k, us) in enumerate(rng.sample(bursts, 200)) if k != "k3"]
    want = []
    for k, us in bursts:
        found = [(at, i) for key, at, i in right if key == k and (at < us or at == us and not strict)]
        want.append((k, us, max(found)[1] if found else None))
    schema = "k string, timestamp timestamp_ntz, i long"
    other = spark.createDataFrame([(k, START + dt.timedelta(microseconds=us), i) for k, us, i in right], schema)
    got = W.asof_join(frame(spark, bursts), other, ["k"], "timestamp", ["i"], strict).collect()
    assert Counter((r["k"], micros_of(r["timestamp"]), r["i"]) for r in got) == Counter(want)


def test_chunked_lag(spark, bursts, ranges):
    rows = [(k, us, i) for i, (k, us) in enumerate(bursts)]
    df = spark.createDataFrame(
        [(k, START + dt.timedelta(microseconds=us), i) for k, us, i in rows], "k string, timestamp timestamp_ntz, i long"
    )
    got = W.chunked_lag(df, ["k"], ["timestamp", "i"], ["i"]).collect()
    want, last = {}, {}
    for k, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k)
        last[k] = i
    assert {r["i"]: r["prev_i"] for r in got} == want


def test_sessions(spark, bursts, ranges):
    want = {}
    for key, times in by_key(bursts).items():
        start = previous = None
        for us in times:
            if previous is None or us - previous >= 20_000_000:
                start = us
            want[key, us] = start
            previous = us
    base = round((START - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    got = W.sessions(frame(spark, bursts).distinct(), ["k"], "timestamp", 20).collect()
    assert {(r["k"], micros_of(r["timestamp"])): r["session"] - base for r in got} == want


def test_recovery_decisions(spark):
    """What has to hold of any decisions, whoever takes them."""
    rng = random.Random(3)
    rows = [("svc", rng.randrange(4_000) * 1_000_000) for _ in range(500)] + [("idle", i * 10**9) for i in range(20)]
    rows += [("svc", (20_000 + rng.randrange(500)) * 1_000_000) for _ in range(100)]
    window, threshold, cooldown, per_hour = 300, 10, 120, 3
    df = frame(spark, rows, "service string, timestamp timestamp_ntz")
    got = A.recovery_decisions(df, window_s=window, threshold=threshold, cooldown_s=cooldown, per_hour=per_hour).collect()
    assert {r["service"] for r in got} == {"svc"} and {r["action"] for r in got} == {"restart", "restart_limit"}
    seconds = Counter(us // 1_000_000 for key, us in rows if key == "svc")
    acted = {micros_of(r["at"]) // 1_000_000: r for r in got}
    restarts = sorted(s for s, r in acted.items() if r["action"] == "restart")
    # The cooldown and the bound of an hour hold.
    assert all(b - a >= cooldown for a, b in zip(restarts, restarts[1:]))
    assert all(sum(s - 3600 < t <= s for t in restarts) <= per_hour for s in restarts)
    used = Counter()  # errors that a restart has used up, by second
    for s in sorted(seconds):
        before = [t for t in restarts if t < s]
        since = max(before, default=-1)
        # Errors in the window that no restart has used, this second's among them.
        free = sum(n - used[t] for t, n in seconds.items() if max(since, s - window) <= t <= s)
        may = (not before or s - since >= cooldown) and free >= threshold
        full = sum(t > s - 3600 for t in before) >= per_hour
        assert (s in acted) == may, s
        if s in acted:
            assert acted[s]["action"] == ("restart_limit" if full else "restart") and threshold <= acted[s]["errors"] <= free
            if not full:
                # Nothing counts twice across a restart: what it used is gone, the rest of its second stays.
                used[s] = seconds[s] - (free - acted[s]["errors"])


def test_rate_limit(spark):
    """What a limiter may never do, whatever it does: too many in a window, a send while open, a lost attempt."""
    rng = random.Random(11)
    rows = [("x", rng.randrange(9_000) * 1_000_000) for _ in range(220)] + [("x", (40_000 + i) * 1_000_000) for i in range(15)]
    window, most, open_s = 300, 10, 1800
    got = {micros_of(r["at"]) // 1_000_000: r for r in A.rate_limit(frame(spark, rows), ["k"], window_s=window, max_sent=most, open_s=open_s).collect()}
    tried = Counter(us // 1_000_000 for _, us in rows)
    assert {s: r["sent"] + r["rate_limited"] + r["circuit_open"] for s, r in got.items()} == dict(tried)
    opened = [s for s, r in got.items() if r["rate_limited"]]
    for s, r in got.items():
        held = sum(o["sent"] for t, o in got.items() if s - window <= t <= s)
        closed = not any(t < s < t + open_s for t in opened)
        assert held <= most
        assert (r["sent"] == 0 and r["rate_limited"] == 0) if not closed else (r["sent"] == tried[s] or held == most)
        assert r["rate_limited"] == (1 if closed and r["sent"] < tried[s] else 0)
    assert opened
    with pytest.raises(ValueError):
        A.rate_limit(frame(spark, rows), [])


def test_grace_holds_back_alerts_not_errors(spark):
    df = frame(spark, [("a", s * 1_000_000) for s in range(0, 400, 20)])
    alerts = A.spike_alerts(df, 300, 10, 1000, started_at=START, grace_s=200).collect()
    assert [(micros_of(r["timestamp"]) // 1_000_000, r["errors"]) for r in alerts] == [(200, 11)]


def test_only_listed_services_restart(spark):
    df = frame(spark, [(k, s * 1_000_000) for k in "ab" for s in range(20)], "service string, timestamp timestamp_ntz")
    assert {r["service"] for r in A.recovery_decisions(df, restartable=["b"]).collect()} == {"b"}


def test_grace_after_every_start(spark):
    df = frame(spark, [(k, s * 1_000_000) for k in "abc" for s in range(0, 100, 10)], "service string, timestamp timestamp_ntz")
    starts = frame(spark, [("a", 5_000_000), ("a", 50_000_000), ("a", 55_000_000), ("b", 90_000_000)], "service string, timestamp timestamp_ntz")
    kept = {(r["service"], micros_of(r["timestamp"]) // 1_000_000) for r in A.after_starts(df, starts, grace_s=20).collect()}
    assert {s for k, s in kept if k == "a"} == {0, 30, 40, 80, 90}
    assert {s for k, s in kept if k == "b"} == set(range(0, 90, 10)) and len({s for k, s in kept if k == "c"}) == 10


def test_boxes_by_confidence(spark):
    boxes = spark.createDataFrame([("i", 0, 0.4), ("i", 1, 0.9), ("i", 2, 0.4), ("j", 0, 0.1)], "path string, box int, confidence double")
    got = sorted((r["path"], r["place"], r["box"]) for r in R.rank_boxes(boxes).collect())
    assert got == [("i", 1, 1), ("i", 2, 0), ("i", 3, 2), ("j", 1, 0)]


def test_grace(spark):
    df = frame(spark, [("a", 0), ("a", 300_000_000)])
    assert A.after_grace(df, START).count() == 1


# --- offers -----------------------------------------------------------------


@pytest.mark.parametrize("blank_once", [False, True])
def test_match_offers(spark, blank_once):
    rng = random.Random(17)
    names = ["linen shirt", "wool coat long", "셔츠 블루"]
    products = [(f"p{i}", f"C{i}0-{i}", names[i % 3], rng.choice([0, 100, 200])) for i in range(12)]
    staged = []
    for pos in range(900):
        i = 0 if pos % 3 == 0 else rng.randrange(12)  # one product holds a third of the offers
        pid, code, name, _ = products[i]
        title = rng.choice([f"<b>{name}</b> {code}", f"{name} c{i}0", "other thing", f"중고 {name}", name[::-1], f"{name[:6]} C{i}0 x"])
        staged.append(
            dict(
                product_id=pid, kind=rng.choice(["ko_name", "en_name", "ko_code", "en_code"]), pos=pos,
                offer_id=rng.choice(["", str(rng.randrange(40))]), title=title, price=rng.randrange(20, 400),
                mall_name=f"m{rng.randrange(9)}", mall_url="u",
            )
        )
    p = spark.createDataFrame(
        [(a, b, "Zara", c, d) for a, b, c, d in products], "product_id string, model_code string, brand_name string, prod_name string, base_price int"
    )
    s = spark.createDataFrame(
        [tuple(o.values()) for o in staged], "product_id string, kind string, pos long, offer_id string, title string, price int, mall_name string, mall_url string"
    )
    about = {pid: (code.split("-")[0].lower(), base) for pid, code, _, base in products}
    passing = {(r["product_id"], r["pos"]) for r in M.acceptable_offers(p, s).collect()}
    by_pos = {o["pos"]: o for o in staged}
    for pid, pos in passing:
        code, base = about[pid]
        offer = by_pos[pos]
        assert "중고" not in offer["title"] and offer["product_id"] == pid
        assert base == 0 or base * 0.3 < offer["price"] < base * 2.5
        assert not offer["kind"].endswith("_code") or code in offer["title"].replace(" ", "").lower()
    taken = [(r["product_id"], r["kind_ord"], r["pos"]) for r in M.accepted_offers(p, s, blank_once).collect()]
    kinds = ("ko_name", "en_name", "ko_code", "en_code")
    assert {(pid, pos) for pid, _, pos in taken} <= passing
    assert max(Counter((pid, k) for pid, k, _ in taken).values()) <= 5
    ids = [(pid, by_pos[pos]["offer_id"]) for pid, _, pos in taken if by_pos[pos]["offer_id"] or blank_once]
    assert len(ids) == len(set(ids))
    # An offer that passes but was not taken: its id was, or five of its kind are at most as dear.
    chosen = {(pid, pos) for pid, _, pos in taken}
    for pid, pos in passing - chosen:
        offer = by_pos[pos]
        kind = [by_pos[q] for q_pid, k, q in taken if q_pid == pid and kinds[k] == offer["kind"]]
        cheaper = [o for o in kind if (o["price"], o["pos"]) < (offer["price"], pos)]
        assert (pid, offer["offer_id"]) in ids or len(cheaper) == 5
    final = M.match_offers(p, s, blank_once).orderBy("product_id", "rank").collect()
    for pid in about:
        own = [r for r in final if r["product_id"] == pid]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 5
        assert len({r["mall_name"] for r in own}) == len(own) and {(pid, r["pos"]) for r in own} <= chosen
        assert [r["price"] for r in own] == sorted(r["price"] for r in own)
        malls = {by_pos[pos]["mall_name"] for q_pid, pos in chosen if q_pid == pid}
        assert len(own) == min(5, len(malls))


def test_staged_from_phrases_is_enough(spark):
    """Against all that phrases find: the same matches, out of rows that grow with products, not with products times offers."""
    rng = random.Random(11)
    names = ["large ring", "large bolt", "large rings set", "tiny bolt"]
    wanted = [(str(i % 88), f"K{i % 88:03d}-{i % 3}", rng.choice(["B1", "b1", "B2", None]), rng.choice(names), rng.choice([0, None, 90, 95, 100, 300])) for i in range(90)]
    products = spark.createDataFrame(wanted, "product_id string, model_code string, brand_name string, prod_name string, base_price int")
    rows = []
    for pos in range(3000):
        name, code = rng.choice(names), f"K{rng.randrange(95):03d}"
        title = rng.choice([f"<b>{name}</b> {code}", f"{name}", f"{code} {name[::-1]}", f"{name} x{code[:2]} {code[2:]} and much more", f"중고 {name}", None])
        price = rng.choice([None, rng.randrange(20, 60), rng.randrange(20, 900)])
        rows.append(("any", rng.choice(["B1", "B2"]), "any", pos // 2, rng.choice(["", None, *map(str, range(40))]), title, price, f"mall{rng.randrange(8)}", "u"))
    kinds = "product_id string, brand_name string, kind string, pos long, offer_id string, title string, price int, mall_name string, mall_url string"
    offers = spark.createDataFrame(rows, kinds)
    own = products.select("product_id", F.lower("brand_name").alias("brand"), F.array_join(M.X.core_tokens(F.lower("prod_name")), " ").alias("query"))
    named = own.join(M.candidate_titles(products, offers), ["brand", "query"]).select("brand", "product_id", "title", F.lit("name").alias("by"))
    coded = own.select("product_id", "brand").join(M.candidate_codes(products, offers), "product_id").select("brand", "product_id", "title", F.lit("code").alias("by"))
    phrases = M.query_phrases(products).select("product_id", "kind", F.substring_index("kind", "_", -1).alias("by"))
    there = offers.withColumn("brand", F.lower("brand_name")).drop("brand_name", "kind", "product_id")
    every = named.unionByName(coded).join(phrases, ["product_id", "by"]).join(there, ["brand", "title"]).drop("brand", "by")
    staged = M.staged_from_phrases(products, offers).cache()

    def matches(found):
        accepted = M.accepted_offers(products, found).select("product_id", "kind_ord", "pos", "offer_id", "title", "price", "mall_name", "similarity").collect()
        ranked = M.match_offers(products, found).select("product_id", "rank", "kind_ord", "pos", "offer_id", "title", "price", "similarity_score").collect()
        return Counter(map(tuple, accepted)), Counter(map(tuple, ranked))

    assert matches(staged) == matches(every) and matches(staged)[1]
    assert staged.filter("kind like '%name'").count() < 90 * 2 * 60 < every.count() / 4


def test_names_stage_what_their_kind_can_take(spark):
    """Five ids for the first kind, ten for the second: twice that was staged, and shuffled with every product."""
    products = spark.createDataFrame([("p", "AB-1", "B1", "large ring", 100), ("q", "AC-1", "B1", "large ring", 90)], "product_id string, model_code string, brand_name string, prod_name string, base_price int")
    rows = [("B1", f"large ring {i}", i, str(i // 2 % 30), 40 + i % 50, f"m{i % 9}", "u") for i in range(300)]
    offers = spark.createDataFrame(rows, "brand_name string, title string, pos long, offer_id string, price int, mall_name string, mall_url string")
    staged = M.staged_from_phrases(products, offers).cache()
    ids = {(r["product_id"], r["kind"]): r["n"] for r in staged.groupBy("product_id", "kind").agg(F.count_distinct("offer_id").alias("n")).collect()}
    assert ids == {(p, kind): n for p in "pq" for kind, n in (("ko_name", 5), ("en_name", 10))} and staged.count() == 30
    got = Counter((r["product_id"], r["kind_ord"], r["offer_id"]) for r in M.accepted_offers(products, staged).collect())
    cheapest = {}
    for _, _, pos, key, price, *_ in rows:
        cheapest[key] = min(cheapest.get(key, (999, 0)), (price, pos))
    order = sorted(cheapest, key=cheapest.get)
    assert got == Counter((p, i // 5, key) for p in "pq" for i, key in enumerate(order[:10]))


def test_seen_id_is_kept_under_the_earlier_kind(spark):
    p = spark.createDataFrame([("p", "AB-1", "Zara", "linen", 100)], "product_id string, model_code string, brand_name string, prod_name string, base_price int")
    rows = [("p", "en_code", 1, "7", "linen AB", 50, "m1", "u"), ("p", "ko_name", 2, "7", "linen", 60, "m2", "u")]
    s = spark.createDataFrame(rows, "product_id string, kind string, pos long, offer_id string, title string, price int, mall_name string, mall_url string")
    got = M.match_offers(p, s).collect()
    assert [(r["kind_ord"], r["price"], r["rank"]) for r in got] == [(0, 60, 1)]


def test_one_offer_per_mall(spark):
    df = spark.createDataFrame([("p", "m", 10, 1), ("p", "m", 12, 2), ("p", "n", 11, 3)], "product_id string, mall_name string, price int, pos int")
    got = R.rank_offers(R.first_per_mall(df, ["product_id"], F.col("price"), F.col("pos")), ["product_id"], [F.col("price")])
    assert sorted((r["price"], r["rank"]) for r in got.collect()) == [(10, 1), (11, 2)]


def test_refine_is_a_partition(spark, small):
    products, offers = D.products(spark, small), D.offers(spark, small)
    clean, bad = J.refine_clean_offers(products, offers).count(), J.refine_anomalies(products, offers).count()
    assert clean + bad == offers.count() and clean and bad


def test_null_base_is_in_neither_set(spark):
    p = spark.createDataFrame([("a", None), ("b", 100)], "product_id string, base_price int")
    o = spark.createDataFrame([("a", 5), ("b", 90)], "product_id string, price int")
    assert [r["product_id"] for r in J.refine_clean_offers(p, o).collect()] == ["b"]
    assert J.refine_anomalies(p, o).count() == 0


def test_not_in_with_null_is_empty(spark):
    p = spark.createDataFrame([("a",), ("b",)], "product_id string")
    o = spark.createDataFrame([("a",), (None,)], "product_id string")
    assert J.products_not_in_offers(p, o).count() == 0
    assert J.products_not_in_offers(p, o.na.drop()).count() == 1


def test_published_version(spark, small, tmp_path):
    products, offers = D.products(spark, small), D.offers(spark, small)
    stored = M.publish_refined(products, offers, str(tmp_path), "v1")
    assert M.current_version(spark, str(tmp_path)) == "v1"
    parts = Counter(r["part"] for r in M.refine_prices(products, offers).collect())
    assert {name: df.count() for name, df in stored.items()} == dict(parts)
    with pytest.raises(Exception):
        M.publish_refined(products, offers, str(tmp_path), "v1")
    # Tables that are not listed yet are not read.
    products.write.parquet(f"{tmp_path}/v2/products_clean")
    assert M.current_version(spark, str(tmp_path)) == "v1"


# --- keyed writes and merges -------------------------------------------------


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, y int")
    delta = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "id int, x string, y int")
    for small_delta in (False, True):
        once = K.upsert_full(base, delta, ["id"], small_delta)
        twice = K.upsert_full(once, delta, ["id"], small_delta)
        assert sorted(once.collect()) == sorted(twice.collect())
        assert sorted(map(tuple, once.collect()), key=lambda r: r[0]) == [(1, "a", 1), (2, None, 5), (3, "c", 6)]
    assert K.merge_partial(base, delta, ["id"]).filter("id = 2").first()["x"] == "b"


def test_right_document_wins_with_null(spark):
    left = spark.createDataFrame([(1, "a", "l")], "id int, x string, only_left string")
    right = spark.createDataFrame([(1, None, "r")], "id int, x string, only_right string")
    row = J.merge_docs(left, right, "id").first()
    assert (row["x"], row["only_left"], row["only_right"]) == (None, "l", "r")


# --- numbering and ranking ---------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_sequence_is_dense_and_stable(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [("hot", "same", i) for i in range(300)] + [("b", f"c{i % 9}", i) for i in range(100)]
        random.Random(1).shuffle(rows)
        df = spark.createDataFrame(rows, "brand string, code string, tie int").repartition(5)
        stored = spark.createDataFrame([("hot", 40)], "brand string, last_seq int")
        out = Q.assign_sequence(df, ["code", "tie"], "brand", stored)
        got = [(r["brand"], r["seq"], r["code"], r["tie"]) for r in out.collect()]
        hot = sorted(g for g in got if g[0] == "hot")
        assert [g[1] for g in hot] == list(range(41, 341)) and [g[3] for g in hot] == list(range(300))
        other = sorted(g for g in got if g[0] == "b")
        assert [g[1] for g in other] == list(range(1, 101)) and [(g[2], g[3]) for g in other] == sorted((g[2], g[3]) for g in other)
        assert {r["brand"]: r["last_seq"] for r in Q.next_sequences(out, "brand").collect()} == {"hot": 340, "b": 100}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_random_rows_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("product_id"))
    a = R.random_rows(df.repartition(3), "product_id", 6, 1).collect()
    b = R.random_rows(df.repartition(11), "product_id", 6, 1).collect()
    assert a == b and a != R.random_rows(df, "product_id", 6, 2).collect()


# --- vectors -----------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 8))
    vectors[7] = 0
    rows = [(str(i), v.tolist(), "a" if i % 2 else "b") for i, v in enumerate(vectors)] + [("none", None, "a")]
    items = spark.createDataFrame(rows, "id string, image_vector array<double>, category string").repartition(6)
    asked = rng.normal(size=(9, 8))
    queries = spark.createDataFrame(
        [(i, v.tolist(), ["a"] if i % 3 == 0 else None) for i, v in enumerate(asked)], "query_id int, vector array<double>, category array<string>"
    )
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(length > 0, length, 1)[:, None]
    scores = np.round((asked / np.linalg.norm(asked, axis=1)[:, None]) @ unit.T, 9)
    want = {}
    for q in range(9):
        order = sorted((-scores[q, i], str(i)) for i in range(400) if q % 3 or i % 2)
        want[q] = [(i, -s) for s, i in order[:15]]
    return items, queries, want


@pytest.mark.parametrize("options", [{}, {"cell": (4, 90)}])
def test_knn_is_exact(corpus, options):
    items, queries, want = corpus
    got = defaultdict(list)
    for r in V.knn(items, queries, "image_vector", 15, ("category",), **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits])


@pytest.mark.parametrize("cells, candidates", [(8, 60), (200, 40), (1, 10)])
def test_inverted_file(spark, corpus, tmp_path, cells, candidates):
    """Most of the exact hits, k of them for every query, with exact scores; all of them where every cell is looked into."""
    items, queries, _ = corpus
    k = 5
    exact = {(r["query_id"], r["id"]): r["score"] for r in V.knn(items, queries, "image_vector", k, ("category",)).collect()}
    index = V.build_inverted_file(items, "image_vector", str(tmp_path), ("category",), cells=cells)
    directed = items.filter(F.exists("image_vector", lambda x: x != 0))
    assert index.table.read().count() == directed.count()
    for wanted, floor in ((candidates, 0.6), (10**6, 1.0)):
        rows = V.knn_inverted_file(index, queries, k, candidates=wanted, cell=(3, 50)).collect()
        near = {(r["query_id"], r["id"]): r["score"] for r in rows}
        both = set(near) & set(exact)
        assert len(near) == len(rows) == len(exact) and len(both) >= floor * len(exact)
        assert all(near[p] == pytest.approx(exact[p], abs=1e-8) for p in both)


def test_inverted_file_of_nothing(spark, corpus, tmp_path):
    items, queries, _ = corpus
    index = V.build_inverted_file(items.limit(0), "image_vector", str(tmp_path), ("category",))
    assert V.knn_inverted_file(index, queries, 5).collect() == []


def test_fusion_values(spark):
    def hits(*rows):
        return spark.createDataFrame(rows, "query_id int, id string, score double, rank int")

    a, b = hits((1, "x", 0.9, 1), (1, "y", 0.5, 2)), hits((1, "x", 0.4, 1))
    got = {r["id"]: r["score"] for r in V.fuse_rrf(a, b).collect()}
    assert got == {"x": pytest.approx(0.7 / 61 + 0.3 / 61), "y": pytest.approx(0.7 / 62)}
    flat = hits((1, "x", 0.9, 1), (1, "y", 0.9, 2))
    assert {r["score"] for r in V.fuse_minmax(flat, b).collect()} == {0.0}


def test_query_without_vectors_is_an_error(spark, corpus):
    items = corpus[0].withColumn("text_vector", F.col("image_vector"))
    queries = spark.createDataFrame([(1, None, None)], "query_id int, image_vector array<double>, text_vector array<double>")
    with pytest.raises(Exception, match="needs an image or a text"):
        V.search(items, queries, filters=()).collect()


# --- pages -------------------------------------------------------------------


def test_specs_last_pair_wins(spark):
    html = "<table><tr><th>A</th><td>1\n 2</td></tr></table><dl><dt>A</dt><dd>3</dd></dl><dl><dt>B</dt><dd><b>4</b></dd></dl>"
    assert spark.range(1).select(H.extract_specs(F.lit(html)).alias("s")).first()["s"] == {"A": "3", "B": "4"}


def test_meta_without_tags(spark):
    row = spark.range(1).select(H.extract_meta(F.lit("<title> a \n b </title>")).alias("m")).first()["m"]
    assert (row["title"], row["name"], row["image"], row["price"]) == ("a b", "a b", "", 0)


# --- skew and partitioning ---------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
@pytest.mark.parametrize("name", ["match_offers", "sliding_error_count", "critical_alerts", "top_errors", "load_catalog", "search"])
def test_answers_do_not_depend_on_partitions(spark, small, name, partitions):
    import __spark_entry__ as entry

    def answer():
        return sorted(map(str, entry.queries()[name](spark, small).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = answer()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert answer() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_product_leaves_few_rows_behind_the_exchange(spark):
    """A third of the offers belong to one product: its tasks send five rows each, not all."""
    offers = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 997).cast("string")).alias("product_id"),
        (F.col("id") * 7919 % 100_003).alias("price"),
        F.col("id").alias("offer_id"),
    )
    ranked = R.rank_offers(offers, ["product_id"], [F.col("price"), F.col("offer_id")])
    rows = ranked.filter("product_id = 'hot'").orderBy("rank").collect()
    want = sorted((i * 7919 % 100_003, i) for i in range(0, 60_000, 3))[:5]
    assert [(r["price"], r["offer_id"]) for r in rows] == want
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
