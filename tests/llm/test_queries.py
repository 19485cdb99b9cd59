"""The operators' queries against their SQL, and the rest against brute force, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm.queries import ORACLES, tokenizer
from tools.check import compare

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck, small):
    ok, note = compare(spark, duck, small, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_order_minhash(spark, small, docs):
    rows = {r.doc_id: r for r in QUERIES["op1_order_minhash"](spark, small).collect()}
    ids = sorted(docs)
    for doc_id, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, start = docs[doc_id].text or "", docs[following].text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + start[:half]
        assert rows[doc_id].n_chars == len(text)
        assert rows[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= rows[doc_id].near_next <= 1 and 0 <= rows[doc_id].near_edited <= 1
    of = defaultdict(set)
    for doc_id, row in rows.items():
        of[docs[doc_id].text].add(row.fingerprint)
    assert all(len(prints) == 1 for prints in of.values())
    long = [r for r in rows.values() if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_multiprobe_lsh(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    data, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = defaultdict(list)
    for r in sorted(QUERIES["op2_multiprobe_lsh"](spark, small).collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 100 == 0}
    hits = 0
    for query, got in found.items():
        distance = np.sqrt(((data - data[ids == query][0]) ** 2).sum(axis=1))
        best = [int(ids[i]) for i in np.lexsort((ids, distance)) if ids[i] != query][:10]
        hits += len(set(best) & {i for i, _ in got})
        assert got == sorted(got, key=lambda x: (x[1], x[0])) and len(got) == 10
        for i, score in got:
            assert score == pytest.approx(distance[ids == i][0], abs=1e-12)
    assert hits >= 0.9 * 10 * len(found)


def test_packing(spark, small, docs):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_mixture_packing"](spark, small).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, row in docs.items():
        ids, at = [*tokens.encode(row.text or "", add_special_tokens=False).ids, 1], 0
        for piece in sorted(pieces[doc_id], key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            at += piece.length
            assert piece.ids_crc32 == zlib.crc32(np.array(ids[piece.start : at], "<u4").tobytes())
        assert at == len(ids)
    for sequence, own in sequences.items():
        at = 0
        for piece in sorted(own, key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        assert at == 2048 or sequence == max(sequences)


def test_quality(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = QUERIES["op5_byte_cnn_quality"](spark, small).collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held_out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held_out]) > 0.85


def test_main_text(spark, small):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["op6_html_main_text"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_language(spark, small, docs):
    rows = QUERIES["op7_language_id"](spark, small).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held_out = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held_out]) > 0.95


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    back = [int(c) for c in reversed(digits)]
    return (sum(back[0::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def spans_by_pattern(text):
    valid = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    found = [
        (m.start(), i, m.end(), kind) for i, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if valid[kind](m[0])
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def test_personal_data(spark, small, docs):
    for r in QUERIES["op9_pii_sanitisation"](spark, small).collect():
        want = spans_by_pattern(docs[r.doc_id].text or "")
        kinds = Counter(s.split(":")[0] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def simhash_by_bits(text, shingle=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_pairs(prints):
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in prints}


def test_simhash(spark, small, docs):
    prints = {d: simhash_by_bits(r.text) for d, r in docs.items()}
    group = groups_by_pairs(prints)
    rows = QUERIES["op10_simhash_near_dedup"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == group[r.doc_id]


def test_pipeline(spark, small, docs):
    """Every stage against what it should have done to what it was given."""
    from tallyloom.llm.common import stored

    frame, kept = spark.read.parquet(f"{small}/documents.parquet"), None
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before, frame = kept, stored(stage(spark, frame, small), name)
        kept = frame.collect()
        if name != "mixture_packing":
            assert frame.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in kept} == {d for d, r in docs.items() if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "simhash_near_dedup":
            group = groups_by_pairs({r.doc_id: simhash_by_bits(r.text) for r in before})
            assert sorted(r.doc_id for r in kept) == sorted(set(group.values()))
        elif name == "pii_sanitisation":
            assert len(kept) == len(before)
            assert not any(spans_by_pattern(r.text) for r in kept)
            texts = {r.doc_id: r.text for r in kept}
            assert all(texts[r.doc_id] == r.text for r in before if not spans_by_pattern(r.text))
        elif name == "source_mixture":
            copies = Counter(r.doc_id for r in kept)
            assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 2
            words = {r.doc_id: len(r.text.split()) for r in before}
            share = sum(words[d] * n for d, n in copies.items()) / sum(words.values())
            assert share == pytest.approx(1.5, abs=0.1)
        else:
            tokens = Counter()
            for r in kept:
                tokens[r.doc_id] += r.length
            copies = Counter(r.doc_id for r in before)
            own = {r.doc_id: r.doc_tokens for r in kept}
            assert tokens == {d: own[d] * n for d, n in copies.items()}
