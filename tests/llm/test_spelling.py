"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import spelling as S
from tests.llm.test_edges import DOCS, ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, every=None):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        good = best is not None and words[best] >= 2 * n
        out[w] = (n, len(near), best if good else None, words[best] if good else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])

    return {(w, *facts, root(w)) for w, facts in out.items()}


def ran(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.grouped(frame, **options).collect()]


def varied(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :], word])


def test_against_brute_force(spark):
    rng = random.Random(8)
    letters = "abcéß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)]
    docs = []
    for i in range(120):
        text = [varied(rng, varied(rng, rng.choice(stems), letters), letters) for _ in range(rng.randrange(60))]
        docs.append((i if i % 10 else None, rng.choice([" ", ", ", "\n", "1", "Łx"]).join(w.title() if rng.random() < 0.2 else w for w in text)))
    for options in ({}, {"drop_every": 7}, {"symbols": 2}):
        got = ran(spark, docs, **options)
        assert len(got) == len(set(got)) and set(got) == brute(docs, options.get("drop_every"))
    assert any(r[5] != r[0] for r in got) and any(r[2] == 0 for r in got) and any(r[2] > 1 for r in got)


def test_chains_lead_to_their_end(spark):
    chain = ["abcdefgh"[:5] + "x" * i for i in range(8)]  # each one letter longer, twice as frequent
    docs = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)))]
    got = {r[0]: r for r in ran(spark, docs)}
    assert {r[5] for r in got.values()} == {chain[-1]} and got[chain[0]][3] == chain[1]
    assert set(got.values()) == brute(docs)


def test_neighbourhoods_are_full():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 4, (20, 6)).astype(np.uint64)
    found = S.neighbourhood(rows, 3)
    for row, got in zip(rows, found, strict=True):
        word = row.tolist()
        wanted = {tuple(word)} | {tuple(word[:i] + word[i + 1 :]) for i in range(6)}
        wanted |= {tuple(word[:i] + [c] + word[i + 1 :]) for i in range(6) for c in (1, 2, 3)}
        wanted |= {tuple(word[:i] + [c] + word[i:]) for i in range(7) for c in (1, 2, 3)}
        assert {int(S.keys(np.array([w], np.uint64))[0]) for w in wanted} == {int(k) for k in got}


def test_words_of_one_reduced_form(spark):
    """Letters of one symbol only: every word of a length has the same reduced form, and most are far apart."""
    rng = random.Random(5)
    same = [chr(c) for c in range(97, 123) if S.symbol_table()[c] == S.symbol_table()[97]]
    words = {"".join(rng.choice(same) for _ in range(6)) for _ in range(60)}
    docs = [(1, " ".join(w for w in sorted(words) for _ in range(3)))]
    assert set(ran(spark, docs)) == brute(docs)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*row, "k", "r", 1, "b", "s") for row in ODD], DOCS).repartition(3)
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.grouped(docs.withColumn("word", F.lit("w")), 97).collect()}
    assert got == brute([(r[0], r[1]) for r in ODD], 97)
    assert S.grouped(docs.limit(0)).collect() == []
    assert S.grouped(docs.where("doc_id = 3")).collect() == []


def test_very_long_words(spark):
    long = "x" * 20_000
    docs = [(1, " ".join([long] * 3 + [long + "y"] * 6 + [long[:-2]] * 3))]
    assert set(ran(spark, docs)) == brute(docs)
