"""Decontamination against brute force, both ways, and at its edges."""

import random
import re

import pytest

from tallyloom.llm import decontamination as D
from tests.llm.test_edges import DOCS, LONG, ODD

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        width = min(window, len(theirs))
        grams = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)} if theirs else set()
        for i in range(len(own) - width + 1):
            if tuple(own[i : i + width]) in grams:
                hit.update(range(i, i + width))
                found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    pool = ["a", "b", "cé", "d1", "ß"]

    def prose(n):
        return rng.choice([" ", "\n", "--", ". "]).join(rng.choice(pool) for _ in range(n))

    items = [(i, prose(rng.randrange(0, 14))) for i in range(40)]
    items += [(3, "the same id a second time"), (None, "no id here"), (77, None), (78, "?!"), (79, "One"), (80, "A B cÉ")]
    docs = [(i, prose(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "no ID here, the same id A SECOND time one"), (100, None), (103, items[0][1] + " " + items[0][1])]
    return docs, items


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, cases, limit):
    docs, items = cases
    got = D.found(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    rows = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect())
    assert rows == sorted((i, *brute(text, items)) for i, text in docs)
    assert any(r[2] for r in rows) and any(not r[2] for r in rows)


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_spans_and_clean_texts(spark, limit):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, "short one")], "item_id long, text string")
    held = "Before, W0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10! W11... then é short  one. After"
    docs = spark.createDataFrame([(1, held, "x"), (2, "clean text, all of it", "y"), (3, None, None)], "doc_id long, text string, words string")
    marked = {r.doc_id: r for r in D.found(docs, bench, limit=limit).collect()}
    assert [(s["first"], s["last"]) for s in marked[1].spans] == [(1, 12), (15, 16)]
    assert [marked[i].n_hit for i in (1, 2, 3)] == [14, 0, 0]
    clean = {r.doc_id: r for r in D.without_spans(docs, bench, limit=limit).collect()}
    assert clean[1].text == "Before, ... then é . After" and clean[2].text == "clean text, all of it" and clean[3].text is None
    assert [clean[i].words for i in (1, 2, 3)] == ["x", "y", None]
    assert sorted(r.doc_id for r in D.without_documents(docs, bench, limit=limit).collect()) == [2, 3]
    assert D.without_documents(docs, bench, share=0.9, limit=limit).count() == 3


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_odd_rows(spark, limit):
    docs = spark.createDataFrame([(*row, "k", "r", 1, "b", "s") for row in ODD], DOCS).repartition(3)
    bench = spark.createDataFrame([(1, LONG), (1, LONG), (2, None), (3, "same text of a few words")], "item_id long, text string")
    rows = D.found(docs, bench, limit=limit).collect()
    assert len(rows) == len(ODD)
    assert next(r for r in rows if r.doc_id == 6).n_hit == 100_000
    assert {r.n_hit for r in rows if r.doc_id in (1, 2)} == {6}
    assert D.without_spans(docs, bench, limit=limit).columns == docs.columns
    assert D.found(docs.limit(0), bench, limit=limit).collect() == []
    none = D.found(docs, bench.limit(0), limit=limit).collect()
    assert len(none) == len(ODD) and not any(r.n_hit for r in none)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    from tallyloom.llm import common

    monkeypatch.setattr(common, "PIECE", 16)
    data = b"aa bb " * 40 + b"c" * 100 + b" dd"
    assert b" ".join(common.pieces(data)).split() == data.split() and len(list(common.pieces(data))) > 5
    assert list(common.pieces(b"")) == [b""]
