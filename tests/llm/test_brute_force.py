"""Cores that SQL cannot express, against the same thing said plainly."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import langid, ordermin, quality
from tallyloom.llm.common import prepared


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def xx(*values):
    """Spark's hash of a row: each value hashed with the hash before it as the seed."""
    seed = 42
    for value in values:
        if isinstance(value, str):
            data = value.encode()
        else:
            value, width = value
            data = (value & (1 << 8 * width) - 1).to_bytes(width, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def order_minhash(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text)
    if not tokens:
        return []
    grams = [xx("first", tokens[0])] + [xx(a, b) for a, b in zip(tokens, tokens[1:])] + [xx(tokens[-1])]
    seen, least = Counter(), defaultdict(lambda: [None, None])
    for place, gram in enumerate(grams):
        seen[gram] += 1
        h = xx((gram, 8), (seen[gram], 4)) & (1 << 64) - 1
        spot = h & (2 * ordermin.BINS - 1)
        held = least[spot >> 1]
        code = (h >> 64 - ordermin.HASH_BITS, place)
        if held[spot & 1] is None or code < held[spot & 1]:
            held[spot & 1] = code
    entries = []
    for at, (a, b) in least.items():
        swapped = a is not None and b is not None and a[1] > b[1]
        first, second = (b, a) if swapped else (a, b)
        values = [(v[0], 8) for v in (first, second) if v is not None]  # a null leaves the hash as it is
        entries.append(at * 65536 + (xx(*values, (int(swapped), 4)) & 65535))
    return sorted(entries)


def test_order_minhash(spark):
    prepared(spark)
    rng = random.Random(2)
    words = ["a", "bb", "ccc", "dddd", "muchlongerthaneight", "é", "中文字"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 10, 100, 800) for _ in range(4)] + [" \n ", "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = ordermin.fingerprints(ordermin.keyed(rows).withColumn("copy", F.lit(1)), ["key", "copy"], ["text"])
    got = {r.key: r.fp_text for r in prints.collect()}
    assert {i: list(got[i] or []) for i in range(len(texts))} == {i: order_minhash(t) for i, t in enumerate(texts)}


def kneser_ney(counts, gram):
    """Interpolated Kneser-Ney probability of a gram's last character, by its definition."""
    levels = {langid.ORDER: counts}
    for n in range(langid.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p = 1 / (len(levels[1]) + 1)
    for n in range(1, langid.ORDER + 1):
        own, level = gram[-n:], levels[n]
        once, twice = (sum(v == c for v in level.values()) for c in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        beside = [v for g, v in level.items() if g[:-1] == own[:-1]]
        if beside:
            total = sum(beside)
            p = max(level.get(own, 0) - discount, 0) / total + max(1 - sum(max(v - discount, 0) for v in beside) / total, 1e-12) * p
    return p


def test_language_models():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabbc é") for _ in range(200)) for _ in range(5)]
    codes, _ = langid.grams(texts)
    unique, counts = np.unique(codes, return_counts=True)

    def chars(code):
        return tuple(int(code) >> 16 * i & 0xFFFF for i in range(langid.ORDER - 1, -1, -1))

    table = Counter({chars(c): int(n) for c, n in zip(unique, counts, strict=True)})
    model = langid.Model(unique, counts)
    asked, _ = langid.grams(["abca bé", "zzz", "é é cb", "a"])
    got = model.probability(asked)
    assert got == pytest.approx([kneser_ney(table, chars(c)) for c in asked], rel=1e-9)
    assert sum(kneser_ney(table, (*chars(asked[3])[1:], c)) for c in {g[-1] for g in table}) <= 1 + 1e-9


def plain_score(network, text):
    data = list(text.ljust(quality.WIDTH, b"\0"))
    places = range(len(data) - quality.WIDTH + 1)
    found = [[sum(float(network.embedding[data[p + w], d]) * float(network.filters[w * quality.DEPTH + d, f]) for w in range(quality.WIDTH) for d in range(quality.DEPTH)) + float(network.bias[f]) for f in range(quality.FILTERS)] for p in places]
    steps = [found[i : i + quality.STEP] for i in range(0, len(found), quality.STEP)]
    chunks = [a + b for a, b in zip(steps, steps[1:])] or steps
    pooled = [[max(0.0, max(row[f] for row in chunk)) for f in range(quality.FILTERS)] for chunk in chunks]
    joined = [sum(c) / len(pooled) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
    return 1 / (1 + math.exp(-(sum(x * float(w) for x, w in zip(joined, network.weights)) + float(network.offset[0]))))


@pytest.mark.parametrize("size", [0, 3, 8, 70, 71, 72, 200, 300])
def test_network_scores(size):
    network = quality.Network()
    text = bytes(random.Random(size).randrange(256) for _ in range(size))
    assert network.score(text) == pytest.approx(plain_score(network, text), abs=1e-5)


def test_gradients_are_slopes():
    """Every parameter's gradient against what a small step does to the loss."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, n, dtype=np.uint8) for n in (40, 150, 400, 9)]
    labels = np.array([1, 0, 1, 0], np.float32)
    network = quality.Network()
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(network, name, getattr(network, name).astype(np.float64))

    def loss():
        p = np.array([network.score(t.tobytes()) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for parameter, gradient in zip(network.parameters(), network.gradients(texts, labels), strict=True):
        some = [i for i in rng.permutation(parameter.size)[:40] if np.ravel(gradient)[i]] or [0]
        for i in some:
            at = np.unravel_index(i, parameter.shape)
            before, step = parameter[at], 1e-6
            parameter[at] = before + step
            up = loss()
            parameter[at] = before - step
            down = loss()
            parameter[at] = before
            assert gradient[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_learning_whole_texts():
    """What tells the classes apart stands in one place of a long text, wherever that is."""
    rng = random.Random(1)

    def text(label):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([20, 200]))]
        if label:
            words[rng.randrange(len(words))] = "zqzqz zqzqz"
        return " ".join(words).encode()

    labels = np.array([i % 2 for i in range(160)], np.float32)
    network = quality.Network()
    network.learn([text(i) for i in labels], labels)
    scores = np.array([network.score(text(i)) for i in labels])
    assert np.mean((scores >= 0.5) == labels) > 0.9


def test_clashing_columns(spark):
    prepared(spark)
    rows = [(i, f"{'good words' if i % 2 else 'bad bad'} {i}", 9, "s", 1, 2) for i in range(20)] + [(3, None, 1, None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, place string, size int, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    network = quality.fit(docs, labels)
    assert len(docs.select("doc_id", quality.scored(docs, network).alias("s")).collect()) == 21
    few = quality.fit(docs, labels, sample_bytes=30)
    assert 0 <= few.score(b"text") <= 1
