"""Quality of texts by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import broadcast

SAMPLE = 2400  # labelled texts the network learns from at most, half of each class
SAMPLE_BYTES = 6 << 20  # bytes of those texts at most; each is learnt from whole, so long ones leave room for fewer
STEP = 64  # a chunk is two steps of positions; neighbouring chunks share one
WIDTH, DEPTH, FILTERS = 8, 4, 32  # bytes a filter sees, numbers that stand for a byte, filters
EPOCHS, BATCH, RATE, DECAY = 14, 48, 0.006, 1e-4
SLICE = 1 << 16  # positions worked on at once
LEARNT_AT_ONCE = 4096  # chunks


class Network:
    """Bytes are embedded and met by filters; each chunk keeps every filter's maximum.

    The mean and the maximum over all chunks go into one logistic unit, so the
    whole text counts and the result does not depend on its length.
    """

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def responses(self, text: np.ndarray) -> np.ndarray:
        """Every filter at every position."""
        embedded = self.embedding[text]
        windows = np.lib.stride_tricks.sliding_window_view(embedded.reshape(-1), WIDTH * DEPTH)[::DEPTH]
        return np.ascontiguousarray(windows) @ self.filters + self.bias

    def pooled(self, text: bytes) -> np.ndarray:
        """Maxima (chunk, filter) of a whole text; a text shorter than a filter is padded with zero bytes."""
        data = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        positions = len(data) - WIDTH + 1
        maxima = []
        for at in range(0, positions, SLICE):
            found = self.responses(data[at : at + SLICE + WIDTH - 1])
            maxima.append(np.maximum.reduceat(found, np.arange(0, len(found), STEP), axis=0))
        steps = np.concatenate(maxima)
        chunks = np.maximum(steps[:-1], steps[1:]) if len(steps) > 1 else steps
        return np.maximum(chunks, 0)

    def score(self, text: bytes) -> float:
        chunks = self.pooled(text)
        logit = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ self.weights + self.offset[0]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def tops(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every chunk of a text each filter's maximum, and the bytes it was taken from (chunk, filter, byte)."""
        positions = len(data) - WIDTH + 1
        maxima, places = [], []
        for at in range(0, positions, SLICE):
            found = self.responses(data[at : at + SLICE + WIDTH - 1])
            short = -len(found) % STEP
            if short:
                found = np.concatenate([found, np.full((short, FILTERS), -np.inf, np.float32)])
            steps = found.reshape(-1, STEP, FILTERS)
            place = steps.argmax(axis=1)
            maxima.append(np.take_along_axis(steps, place[:, None], axis=1)[:, 0])
            places.append(place + (at + np.arange(len(steps)) * STEP)[:, None])
        top, place = np.concatenate(maxima), np.concatenate(places)
        if len(top) > 1:
            later = top[1:] > top[:-1]
            top, place = np.where(later, top[1:], top[:-1]), np.where(later, place[1:], place[:-1])
        return np.maximum(top, 0), data[place[:, :, None] + np.arange(WIDTH)]

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the log loss over a batch of whole texts, pooled over all their chunks as for scoring.

        A maximum hands its gradient to the one position it was taken from.
        """
        each = [self.tops(data) for data in texts]
        top, bytes_at = np.concatenate([t for t, _ in each]), np.concatenate([b for _, b in each])
        sizes = np.array([len(t) for t, _ in each])
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(top, starts) / sizes[:, None]
        most = np.maximum.reduceat(top, starts)
        joined = np.concatenate([mean, most], axis=1)
        wrong = 1 / (1 + np.exp(-np.clip(joined @ self.weights + self.offset[0], -30, 30))) - labels
        wrong = (wrong / len(texts)).astype(np.float32)
        back = (wrong[owner] / sizes[owner]).astype(np.float32)[:, None] * self.weights[:FILTERS]
        is_most = top == most[owner]
        shared = np.maximum(np.add.reduceat(is_most.astype(np.float32), starts)[owner], 1)
        back = np.where(top > 0, back + is_most / shared * wrong[owner][:, None] * self.weights[FILTERS:], 0)
        filters, embedding = np.zeros((WIDTH * DEPTH, FILTERS), np.float32), np.zeros((256, DEPTH))
        for at in range(0, len(back), LEARNT_AT_ONCE):
            part, places = back[at : at + LEARNT_AT_ONCE], bytes_at[at : at + LEARNT_AT_ONCE]
            seen = self.embedding[places].reshape(len(part), FILTERS, WIDTH * DEPTH)
            filters += np.matmul(seen.transpose(1, 2, 0), part.T[:, :, None])[:, :, 0].T
            to_bytes = (part[:, :, None] * self.filters.T[None]).reshape(-1, DEPTH)
            embedding += np.stack([np.bincount(places.reshape(-1), to_bytes[:, d], 256) for d in range(DEPTH)], axis=1)
        return [embedding, filters, back.sum(axis=0), wrong @ joined, np.array([wrong.sum()])]

    def learn(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> None:
        """Adam over whole texts."""
        data = [np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8) for text in texts]
        rng, first, second, step = np.random.default_rng(seed), None, None, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(data))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                found = self.gradients([data[i] for i in some], labels[some])
                step += 1
                first = first or [np.zeros_like(p) for p in self.parameters()]
                second = second or [np.zeros_like(p) for p in self.parameters()]
                for p, g, m, v in zip(self.parameters(), found, first, second, strict=True):
                    g = g + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network that learns ``quality`` of ``labels`` (doc_id, quality) from the texts of ``docs``.

    At most ``sample`` texts, half of each class, chosen by a hash of the id
    from all labelled ones, and of those as many as ``sample_bytes`` hold, each
    whole; their ids, a bounded number, are broadcast. The offset is then moved
    to the classes' shares among all labels. A text with contrary labels counts
    as 0, a repeated id gives its smallest text. Without both classes the score
    is the share of 1, or 0.5 without labels.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {row.quality: row.n for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    network = Network()
    shares = (counts.get(0, 0) + 1e-3) / (counts.get(1, 0) + 1e-3)
    if not (counts.get(0) and counts.get(1)):
        network.weights[:] = 0
        network.offset[0] = -np.log(shares)
        return network
    chosen = None
    for quality in (0, 1):
        some = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id", "quality").agg(F.min(F.octet_length("text")).alias("size"), F.min(F.xxhash64("doc_id")).alias("place")).collect()
    taken, left = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for row in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if row["size"] <= left[row.quality]:
            left[row.quality] -= row["size"]
            taken.append((row.doc_id, row["size"]))
    some = docs.sparkSession.createDataFrame(taken, f"doc_id {dict(docs.dtypes)['doc_id']}, size int")
    rows = rows.join(F.broadcast(some), "doc_id").where(F.octet_length("text") == F.col("size"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    if rows["quality"].nunique() == 2:
        network.learn([t.encode() for t in rows["text"]], rows["quality"].to_numpy().astype(np.float32))
        drawn = rows["quality"].value_counts()
        network.offset[0] += np.log(drawn[0] / drawn[1]) - np.log(shares)
    return network


def scored(docs: DataFrame, network: Network) -> Column:
    """Probability of label 1 for the column ``text`` of ``docs``; every byte of a text is read, a null one is empty."""
    shared = broadcast(docs.sparkSession, network)

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared()
        for texts in batches:
            yield pd.Series([own.score((t or "").encode()) for t in texts], dtype="float64")

    return of(F.col("text"))
