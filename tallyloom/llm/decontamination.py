"""Benchmark decontamination: a broadcast hash set of the items' word windows, scanned over whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import broadcast, pieces, row_key

WINDOW = 10  # words
BROADCAST_BYTES = 4 << 20  # of benchmark text; beyond it windows are joined instead of broadcast
BLOCK = 1 << 20  # windows of a document looked up at a time

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text: digits, a to z, all beyond ASCII

FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, last: bigint>>, items: array<string>>"


def normalised(text: Column) -> Column:
    """The words of a text column, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _byte_table() -> bytes:
    """Bytes of UTF-8 text to the same bytes, lower-cased, with a space for all that is in no word."""
    table = bytearray(b" " * 256)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = range(low, high + 1)
    table[0x41:0x5B] = range(0x61, 0x7B)
    return bytes(table)


class Windows:
    """The windows of all items: per length their hashes in order, their word numbers and the items that have them."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        self.items = sorted({item for item, _ in items})
        index = {item: i for i, item in enumerate(self.items)}
        for item, words in items:
            ids = np.array([self.number.setdefault(w.encode(), len(self.number)) for w in words], np.int32)
            length = min(window, len(ids))
            own = np.lib.stride_tricks.sliding_window_view(ids, length)
            rows.setdefault(length, []).append(own)
            owners.setdefault(length, []).append(np.full(len(own), index[item], np.int32))
        self.factors = np.random.default_rng(11).integers(1 << 62, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        self.lengths = {}
        for length in sorted(rows):
            unique, which = np.unique(np.concatenate(rows[length]), axis=0, return_inverse=True)
            hashes = self.hash(unique.T)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            whose = np.unique(np.stack([place[which.ravel()], np.concatenate(owners[length])], axis=1), axis=0)
            starts = np.searchsorted(whose[:, 0], np.arange(len(order) + 1))
            ties = int(np.unique(hashes, return_counts=True)[1].max())
            self.lengths[length] = (hashes[order], unique[order], starts, whose[:, 1].astype(np.int32), ties)

    def hash(self, columns) -> np.ndarray:
        """One hash per window of ``columns``, the windows' first words, second words and so on."""
        total = np.uint64(0)
        for factor, column in zip(self.factors, columns, strict=False):
            total = total + column.astype(np.uint64) * factor
        return total ^ (total >> np.uint64(31))

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Runs of hit words as rows (first, last), and the items that hit, for a document's word numbers (-1: in no item)."""
        none = np.empty((0, 2), np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        depth, items = None, set()
        for length, (hashes, rows, starts, owners, ties) in self.lengths.items():
            if len(ids) < length:
                continue
            spots = np.flatnonzero(known[length:] - known[:-length] == length)
            for at in np.split(spots, range(BLOCK, len(spots), BLOCK)):
                wanted = self.hash(ids[at + i] for i in range(length))
                place = np.searchsorted(hashes, wanted)
                for tie in range(ties):
                    near = np.minimum(place + tie, len(hashes) - 1)
                    same = np.flatnonzero(hashes[near] == wanted)
                    # Equal hashes are verified word by word.
                    same = same[(rows[near[same]] == ids[at[same][:, None] + np.arange(length)]).all(axis=1)]
                    if not len(same):
                        continue
                    if depth is None:
                        depth = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(depth, at[same], 1)
                    np.add.at(depth, at[same] + length, -1)
                    for window in np.unique(near[same]):
                        items.update(owners[starts[window] : starts[window + 1]].tolist())
        if depth is None:
            return none, []
        hit = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        return np.stack([edges[::2], edges[1::2] - 1], axis=1), [self.items[i] for i in sorted(items)]


def _scanned(text: Column, held) -> Column:
    """A struct FOUND per text, by the broadcast windows."""
    table = _byte_table()

    @pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = held()
        get = windows.number.get
        for texts in batches:
            out = []
            for text in texts:
                parts = [np.array([get(w, -1) for w in part.split()], np.int32) for part in pieces((text or "").encode().translate(table))]
                ids = np.concatenate(parts)
                spans, items = windows.scan(ids)
                out.append((len(ids), [{"first": a, "last": b} for a, b in spans.tolist()], items))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return scan(text)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, words) of the items with a word; an item without an id goes by the empty text."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normalised(F.col("text")).alias("words"))
    return rows.where(F.size("words") > 0)


def _windows(words: str, length: Column) -> Column:
    """The windows of ``length`` words of an array column, each as a text."""
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, length), " "))


def _joined(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``docs`` with the struct ``__found``, by a join on the windows themselves: for benchmarks beyond the broadcast."""
    lasting = _items(benchmark).withColumn("length", F.least(F.lit(window), F.size("words")))
    held = lasting.select("item", F.explode(_windows("words", F.col("length"))).alias("window")).distinct()
    lengths = sorted(r.length for r in lasting.select("length").distinct().collect())  # at most ``window`` numbers
    keyed = docs.withColumn("__row", row_key(docs))
    spots = keyed.select("__row", normalised(F.col("text")).alias("words")).select(
        "__row", "words", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("length")
    )
    spots = spots.select("__row", "length", F.posexplode(_windows("words", F.col("length"))).alias("at", "window"))
    hits = spots.join(held.select("window").distinct(), "window").distinct()
    # Windows in order; one that does not touch those before begins a run.
    ordered = Window.partitionBy("__row").orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    placed = hits.select("__row", F.col("at").cast("long").alias("first"), (F.col("at") + F.col("length") - 1).cast("long").alias("last"))
    begun = placed.withColumn("begins", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    runs = begun.withColumn("run", F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("__row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = runs.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__spans"))
    whose = hits.select("__row", "window").distinct().join(held, "window").select("__row", "item").distinct()
    items = whose.groupBy("__row").agg(F.array_sort(F.collect_list("item")).alias("__items"))
    both = keyed.join(spans.join(items, "__row"), "__row", "left")
    found = F.struct(
        F.size(normalised(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce("__spans", F.array().cast("array<struct<first: bigint, last: bigint>>")).alias("spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
    )
    return both.select(*docs.columns, found.alias("__found"))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the struct ``__found``: n_words, spans (runs of hit words, numbered from 0), items that hit.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter item; every word of an occurrence is hit. The benchmark's size is
    counted first. Up to ``limit`` bytes of text its windows are broadcast as
    hash sets, each document is scanned in one pass without a shuffle, and
    equal hashes are verified word by word. Beyond that the documents' windows
    are joined to the benchmark's.

    Null and empty texts have no words. Items without words match nothing;
    items that share an id are one item, those without an id go by the empty
    text. Repeated documents are marked alike, an empty table of either kind
    is fine, other columns are kept.
    """
    held = _items(benchmark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > limit:
        return _joined(docs, benchmark, window)
    windows = Windows([(r.item, r.words) for r in held.collect()], window)
    sent = broadcast(docs.sparkSession, windows)
    return docs.select("*", _scanned(F.col("text"), sent).alias("__found"))


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per document, see ``marked``."""
    rows = marked(docs.select("doc_id", "text"), benchmark, window, limit)
    width = F.aggregate("__found.spans", F.lit(0).cast("long"), lambda n, s: n + s.last - s.first + 1)
    return rows.select("doc_id", "__found.n_words", width.alias("n_hit"), "__found.spans", "__found.items")


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with every run of hit words cut out of the text, from its first word to the end of its last."""
    table = _byte_table()

    @pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, runs in batches:
            out = []
            for text, spans in zip(texts, runs, strict=True):
                if text is not None and len(spans):
                    data = text.encode()
                    inside = np.frombuffer(b" " + data.translate(table) + b" ", np.uint8) != 32
                    edges = np.flatnonzero(inside[1:] != inside[:-1])
                    starts, ends, kept, at = edges[::2], edges[1::2], [], 0
                    for span in spans:
                        kept.append(data[at : starts[span["first"]]])
                        at = ends[span["last"]]
                    text = b"".join([*kept, data[at:]]).decode()
                out.append(text)
            yield pd.Series(out, dtype=object)

    rows = marked(docs, benchmark, window, limit)
    clean = F.when(F.size("__found.spans") > 0, cut(F.col("text"), F.col("__found.spans"))).otherwise(F.col("text"))
    return rows.withColumn("text", clean).select(*docs.columns)


def without_documents(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.0, window: int = WINDOW, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``share`` are hit."""
    rows = marked(docs, benchmark, window, limit)
    width = F.aggregate("__found.spans", F.lit(0).cast("long"), lambda n, s: n + s.last - s.first + 1)
    return rows.where(width <= F.lit(share) * F.col("__found.n_words")).select(*docs.columns)
