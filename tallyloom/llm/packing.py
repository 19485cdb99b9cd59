"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import id_block, running_total, source_key, stored, worker_memo

LENGTH = 2048  # tokens of a sequence
WINDOW = 32 * LENGTH  # tokens in which the sources meet their proportions
END = 1  # id behind every document
CACHED = 600_000  # words whose ids a worker remembers before it starts anew
LEARNT = 5_000  # words encoded in one call, which holds much more than their ids
TEXT_BYTES = 2 << 20  # bytes of text in which equal words are looked up once

# What a byte of a text is: white space 0, a letter 1, a digit 4, another sign 2. Bytes whose kinds share one of the lower
# two bits are never cut apart; an apostrophe has both, since it may begin a piece with letters, or end one with signs.
# 8 is added where UTF-8 has anything but printable ASCII, tabs, line feeds and the letters of Latin-1, which begin with 0xC3.
KIND = np.full(256, 2, np.uint8)
KIND[[*b"\t\n "]] = 0
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
KIND[[*b"0123456789"]] = 4
KIND[ord("'")] = 3
KIND[[*set(range(0x20)) - set(b"\t\n"), 0x7F, 0x97, 0xB7, *set(range(0xC0, 0x100)) - {0xC3}]] |= 8
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[*b"\t\n"]] = ord(" ")
LOWERED = SPACED.copy()
LOWERED[ord("A") : ord("Z") + 1] += 32


class WordIds:
    """Ids of the words of texts, each encoded once by the tokenizer.

    The tokenizer's normaliser and its splitting never reach over white space,
    so a text's ids are its words' ids in a row. Texts of ASCII and Latin-1
    letters need no Unicode normalisation: they are lower-cased first and also
    cut between letters, digits and signs, which leaves fewer words to
    remember, and their words, split by the tokenizer's own pattern, are
    encoded in one call; other words, and those that may hold a special token,
    go through the whole tokenizer.

    Texts are cut as bytes, many at a time. Equal words among them are found by
    Arrow's dictionary, so that only different ones are looked up, and the ids
    are put in a row by Arrow too.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the tokenizer's

    def __init__(self, spec: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(spec)
        self.pieces = None
        own = json.loads(spec)
        suffix = own["model"].get("end_of_word_suffix")
        if suffix and self.PATTERN in json.dumps(own["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            self.pieces = Tokenizer(self.whole.model)
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            vocabulary = self.whole.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.split = regex.compile(self.PATTERN).findall
        self.plain = regex.compile(r"[\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def is_plain(self, text: str) -> bool:
        """Whether the tokenizer only lower-cases this text and splits it by its pattern."""
        return self.pieces is not None and "<|" not in text and (text.isascii() and text.isprintable() or self.plain(text) is not None)

    def by_whole(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, words: list[str]) -> None:
        """Add the ids of ``words``. A piece of a word is a word of its own, so pieces are remembered too."""
        known, plain = self.known, words
        if not self.is_plain(" ".join(words)):
            plain = [word for word in words if self.is_plain(word)]
            known.update((word, self.by_whole(word)) for word in set(words).difference(plain))
        split = {word: [low] if low.isalpha() else self.split(low) for word, low in zip(plain, map(str.lower, plain), strict=True)}
        parts = list({part for own in split.values() for part in own if part not in known})
        if parts:
            found = self.pieces.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            cuts = [0, *((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()]
            if len(cuts) == len(parts) + 1:
                data = ids.tobytes()
                known.update(zip(parts, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:  # a model that leaves out the end of some piece
                known.update((part, self.by_whole(part)) for part in parts)
        known.update((word, b"".join([known[part] for part in own])) for word, own in split.items() if word not in known)

    def cut(self, data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of texts that lie end to end in ``data`` and begin at ``rows``, and how many come before each text."""
        kinds, low = KIND[data], LOWERED[data]
        other = kinds > 7
        other[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        odd = np.unique(np.searchsorted(rows, np.flatnonzero(other), "right") - 1) if self.pieces is not None else np.arange(len(rows) - 1)
        for a, b in zip(rows[odd].tolist(), rows[odd + 1].tolist(), strict=True):
            low[a:b] = SPACED[data[a:b]]
            kinds[a:b] = low[a:b] != ord(" ")
        kept = kinds > 0
        first = kept.copy()
        first[1:] &= (kinds[1:] & kinds[:-1] & 3) == 0
        begun = rows[rows < len(data)]
        first[begun] = kept[begun]
        before = np.searchsorted(np.flatnonzero(first), rows)
        low = low[kept]
        starts = np.append(np.flatnonzero(first[kept]), len(low))
        return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low)]), before

    def rows(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id behind them, as bytes."""
        texts = texts.fill_null("").cast(pa.large_string())
        _, rows, data = texts.buffers()
        rows = np.frombuffer(rows, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]] if data else np.empty(0, np.uint8)
        words, before = self.cut(data, rows - rows[0])
        found = words.dictionary_encode()
        different = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = [*map(self.known.get, different)]
        fresh = [word for word, ids in zip(different, values, strict=True) if ids is None]
        if len(self.known) + len(fresh) > CACHED:
            self.known, values, fresh = {}, [None] * len(different), different
        if fresh:
            for k in range(0, len(fresh), LEARNT):
                self.learn(fresh[k : k + LEARNT])
            values = [self.known[word] if ids is None else ids for word, ids in zip(different, values, strict=True)]
        values.append(np.array([END], self.dtype).tobytes())
        places = np.insert(found.indices.to_numpy(), before[1:], len(different))
        ids = pa.array(values, pa.large_binary()).take(pa.array(places))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[before + np.arange(len(before))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.rows(pa.array(texts, pa.string())).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in larger ones, of about ``size`` bytes in ``column``."""
    held, full = [], 0
    for batch in batches:
        held.append(batch)
        full += batch.column(column).nbytes
        if full >= size:
            yield pa.concat_batches(held)
            held, full = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(row, doc_id, source, ids, n): every document's ids with the end id; a null text has that alone.

    The texts are encoded once; the ids are kept in the shared folder in two
    bytes each where the vocabulary allows, and a row keeps its number.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memo(f"words {tokenizer}", lambda: WordIds(spec.value))
        for batch in gathered(batches, "text", TEXT_BYTES):
            ids = words.rows(batch.column("text")).cast(pa.binary())
            n = pc.divide(pc.binary_length(ids), words.dtype.itemsize).cast(pa.int64())
            columns = [batch.column("doc_id"), batch.column("source"), ids, n]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "ids", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    encoded = rows.mapInArrow(encode, "doc_id long, source string, ids binary, n long")
    return stored(encoded.withColumn("row", F.monotonically_increasing_id()), "tokens")


def layout(tokens: DataFrame, window: int = WINDOW, length: int = LENGTH, weights: DataFrame | None = None) -> DataFrame:
    """(row, start, length, sequence_id, offset): where each piece of each document goes.

    Every source has a queue of its documents, cut into packets of at most
    ``length`` tokens. In each window a source's deficit grows by its quantum,
    the window's size times the source's proportion, and the queue is served
    while the deficit covers the next packet; the rest is carried on. A packet
    that ends at token E of its queue is therefore served in the first window
    by whose end the quanta add up to E, so no state walks through the queues
    and partitions need not wait for each other. Proportions are the sources'
    shares of all tokens, so that all queues end together, or those of
    ``weights`` (source, weight). Windows follow each other without padding
    and are cut every ``length`` tokens; only the last sequence is shorter.
    """
    rows = tokens.select("row", "doc_id", "source", "n", id_block(F.col("doc_id")).alias("block"), F.xxhash64("ids").alias("digest"))
    queued = running_total(rows, ["source"], "block", ["doc_id", "n", "digest", "row"], "n", "before")
    totals = rows.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        shares = totals.withColumn("weight", F.col("tokens").cast("double"))
    else:
        shares = totals.join(weights, "source", "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quantum = F.lit(float(window)) * F.col("weight") / F.sum("weight").over(everything)
    shares = shares.select("source", quantum.alias("quantum"))
    packets = queued.join(shares, "source").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(length).cast("long"))))
    packets = packets.withColumn("size", F.least(F.lit(length).cast("long"), F.col("n") - F.col("start")))
    packets = packets.withColumn("end", F.col("before") + F.col("start") + F.col("size"))
    packets = packets.withColumn("window", F.ceil(F.col("end") / F.col("quantum")) - 1)
    packets = packets.withColumn("stretch", F.col("window").bitwiseAND(F.lit(~1023).cast("long")))
    windows = packets.groupBy("stretch", "window").agg(F.sum("size").alias("filled"))
    windows = running_total(windows.withColumn("all", F.lit(0)), ["all"], "stretch", ["window"], "filled", "base")
    earlier = Window.partitionBy("window").orderBy("source", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("inside", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(windows.select("window", "base"), "window")
    placed = placed.select("row", "start", "size", (F.col("base") + F.col("inside")).alias("at"))
    last = F.expr(f"(at + size - 1) div {length}")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {length}"), last)))
    first = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("size"), (F.col("sequence_id") + 1) * length - F.col("at"))
    return pieces.select(
        "row", (F.col("start") + first).alias("start"), (stop - first).alias("length"), "sequence_id", ((F.col("at") + first) % length).alias("offset")
    )


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts give one piece, the end id. Null sources are one
    queue; repeated rows are packed one by one, equal ones in either order; an
    empty table gives no pieces. A very long text is many packets.
    """
    tokens = tokenized(docs, tokenizer)
    pieces = layout(tokens, window, length)
    own = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = tokens.select("row", "doc_id", "ids", "n").join(own, "row").select("doc_id", "ids", "n", "pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            rows = []
            for doc_id, ids, n, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "pieces")), strict=True):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for p in places:
                    crc = zlib.crc32(memoryview(wide)[4 * p["start"] : 4 * (p["start"] + p["length"])])
                    rows.append((doc_id, p["start"], p["length"], crc, n, p["sequence_id"], p["offset"]))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(
        digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
