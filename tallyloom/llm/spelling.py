"""Spelling variants: one-edit neighbourhoods over a reduced alphabet, verified on the words themselves."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import pieces, stored

SYMBOLS = 8  # letters of the reduced alphabet
KEPT = 500_000  # distinct words a task counts before it hands them on
ROWS = 1 << 20  # rows of a batch of probes, about

LEAST_LENGTH, LEAST_COUNT = 5, 3


def _letter_table() -> bytes:
    """Latin-1 bytes to the same bytes with A-Z lower-cased, and a space for all that is no letter."""
    table = bytearray(b" " * 256)
    table[0x61:0x7B] = range(0x61, 0x7B)
    table[0x41:0x5B] = range(0x61, 0x7B)
    table[0xC0:0x100] = range(0xC0, 0x100)
    return bytes(table)


def counted(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at least five letters and three occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF. With ``drop_every`` a letter is
    dropped from some occurrences: with h the crc32 of ``<doc_id>:<run>``,
    where ``drop_every`` divides h, the one at h modulo the run's length. A
    null id counts as the empty text, a null text has no words. Tasks count
    words before they are shuffled; a long text is split a piece at a time.
    """
    table = _letter_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in kept]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])
            kept.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text.encode("latin-1", "replace").translate(table)):
                    for run, n in Counter(piece.split()).items():
                        if len(run) < LEAST_LENGTH:
                            continue
                        if drop_every:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                            if h % drop_every == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                        if len(run) >= LEAST_LENGTH:
                            kept[run] += n
                if len(kept) > KEPT:
                    yield handed_on()
        yield handed_on()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbol_table(symbols: int = SYMBOLS) -> np.ndarray:
    """The symbol, from 1, of every Latin-1 letter: its code point hashed."""
    codes = np.arange(256, dtype=np.uint64) * np.uint64(2654435761)
    return (codes >> np.uint64(13)) % np.uint64(symbols) + np.uint64(1)


# An odd number and its inverse modulo 2^64: keys of reduced words are polynomials in it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(count: int) -> np.ndarray:
    steps = np.full(count, BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key per row of symbols."""
    return (rows * _powers(rows.shape[1])[::-1]).sum(axis=1, dtype=np.uint64)


def neighbourhood(rows: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The keys, per row of symbols, of the row itself and of all that one edit makes of it; some may repeat.

    Keys of edited rows come from sums over what stands before and behind the
    edit, so none is written out.
    """
    count, length = rows.shape
    weights = _powers(length + 1)[::-1]  # the weight of an inserted symbol at each place
    own = rows * weights[1:]
    zero = np.zeros((count, 1), np.uint64)
    before = np.concatenate([zero, np.cumsum(own, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    behind = whole - before
    parts = [whole, before[:, :-1] * np.uint64(INVERSE) + behind[:, 1:]]
    shifted = before * np.uint64(BASE) + behind
    for symbol in range(1, symbols + 1):
        parts.append(whole + (np.uint64(symbol) - rows) * weights[1:])
        parts.append(shifted + np.uint64(symbol) * weights)
    return np.concatenate(parts, axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length at a time: their places and their letters as rows of Latin-1 codes."""
    coded = [w.encode("latin-1") for w in words]
    places: dict[int, list[int]] = {}
    for place, word in enumerate(coded):
        places.setdefault(len(word), []).append(place)
    for length, own in places.items():
        step = max(1, ROWS // (2 * SYMBOLS * (length + 1)))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            yield some, np.frombuffer(b"".join([coded[i] for i in some]), np.uint8).reshape(len(some), length)


def filed(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, reduced, key): every word with its reduced form, stored."""
    table = symbol_table(symbols)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = (table + np.uint64(0x60)).astype(np.uint8)
        for batch in batches:
            words = batch.column("word").to_pylist()
            reduced, key = [""] * len(words), np.zeros(len(words), np.uint64)
            for places, rows in _by_length(words):
                key[places] = keys(table[rows])
                for place, row in zip(places, letters[rows], strict=True):
                    reduced[place] = row.tobytes().decode("latin-1")
            columns = [batch.column("word"), batch.column("n"), pa.array(reduced, pa.string()), pa.array(key.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "reduced", "key"])

    return stored(words.mapInArrow(reduce, "word string, n long, reduced string, key long"), "words")


def probes(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(key, probe): the keys of the full one-edit neighbourhood of every word of column ``reduced``."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in _by_length(batch.column("reduced").to_pylist()):
                codes = rows.astype(np.uint64) - np.uint64(0x60)
                found = np.sort(neighbourhood(codes, symbols), axis=1)
                fresh = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                own = np.repeat(keys(codes), fresh.sum(axis=1))
                columns = [pa.array(own.view(np.int64)), pa.array(found[fresh].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "probe"])

    return reduced.select("reduced").mapInArrow(generate, "key long, probe long")


def near(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, near_n, near): per word of ``filed`` with a neighbour the number of words one edit away, and the most frequent one.

    Ties go to the smallest in code-point order. Neighbourhoods are made once
    per reduced word and joined to the reduced vocabulary; only the matches are
    joined to the words, whose distance is then verified. No word has more
    neighbours than its length and the letters allow, so gathering by word
    is bounded.
    """
    # A row makes a hundred and more, so there are as many tasks as for what they make.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reduced = words.select("reduced", "key").repartition(tasks, "reduced", "key").distinct()
    known = reduced.select(F.col("key").alias("probe")).distinct()
    beside = probes(reduced, symbols).join(known, "probe")
    mine = words.select("key", "word", "n")
    other = words.select(F.col("key").alias("probe"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = mine.join(beside, "key").join(other, "probe").where(F.levenshtein("word", "near", 1) == 1)
    # A set, so that reduced words which share a key do no harm.
    others = F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = pairs.groupBy("word", "n").agg(others.alias("others")).withColumn("best", F.array_min("others"))
    return found.select("word", "n", F.size("others").cast("long").alias("n_near"), (-F.col("best.less")).alias("near_n"), "best.near")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) for every word of ``links`` (word, form): the last form that the links lead to.

    Every round doubles the links that are followed. Forms grow at least
    twofold, so chains are no longer than the logarithm of the largest count.
    """
    now = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = now.join(step, "root", "left")
        now = stored(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
    return now.select("word", "root")


def grouped(docs: DataFrame, drop_every: int | None = None, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``counted``.

    ``form`` is the near word of the largest n, if that is at least twice the
    word's own, else null; ``root`` where forms lead, the word itself without
    one. Null and empty texts have no words, repeated rows count again, an
    empty table gives no rows, other columns are not read.
    """
    words = filed(counted(docs, drop_every), symbols)
    beside = stored(near(words, symbols), "near")
    forms = beside.where("near_n >= 2 * n").select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    led = forms.join(followed(forms), "word")
    rows = words.select("word", "n").join(beside.select("word", "n_near"), "word", "left").join(led, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
