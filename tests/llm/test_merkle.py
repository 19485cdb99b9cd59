"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle as M
from tests.llm.test_edges import DOCS, ODD


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes, fanout=16):
    """(root, per node its list of (left, right) siblings) of a list of hashes."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, at in enumerate(where):
            run = at // fanout * fanout
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
            where[i] = at // fanout
        level = [H("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text): the contract's columns by position."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    grown = [climbed([leaf(r) for r in trees[n]]) for n in names]
    root, tops = climbed([subroot for subroot, _ in grown])
    out = []
    for name, (subroot, paths), top in zip(names, grown, tops, strict=True):
        for row, path in zip(trees[name], paths, strict=True):
            whole = path + top
            now = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in whole:
                now = H(left + now + right)
            out.append((row[0], leaf(row), subroot, root, H("".join(a + b for a, b in whole)), now, now == root))
    return out


def ran(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return M.manifest(docs, tampered, F.translate("text", M.UPPER, M.LOWER))


def compare(docs, rows):
    found = ran(docs).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


@pytest.mark.parametrize("counts", [{"a": 300, "b": 16, "c": 17, "d": 1, None: 5}, {f"s{i:02}": 1 + i % 3 for i in range(40)}, {"only": 257}, {"one": 1}])
def test_against_a_plain_tree(spark, counts):
    rng = random.Random(1)
    rows = []
    for source, n in counts.items():
        for _ in range(n):
            doc_id = len(rows) * 3
            rows.append((doc_id, source, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Text É %d" % doc_id, "small"])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = compare(docs, rows)
    assert any(r[6] for r in got)
    if len(rows) > 100:
        assert any(not r[6] for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*row, "k", "r", 1, "b", "s") for row in ODD], DOCS).repartition(3)
    compare(docs.withColumn("hash", F.lit("x")), [(i, source, lang, n, text) for i, text, lang, source, n in ODD])
    assert ran(docs.limit(0)).collect() == []


def test_untampered_documents_verify(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = M.manifest(docs).collect()
    assert len(rows) == 100 and all(r.verified for r in rows) and len({r.root for r in rows}) == 1
    assert all(len(r.path) == 3 for r in rows)  # two levels of 34 or 33 leaves, one of three sources
