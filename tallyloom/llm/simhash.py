"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import components, row_key, stored

SHINGLE = 3  # words
MAX_BITS = 3  # differing bits of two linked fingerprints


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    count = len(words) - width + 1
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype="<u8", count=count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column, as a signed long; a null text has no words."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t.encode() if t else None, shingle) for t in texts], dtype="int64")

    return of(text)


def _ball(segment: int, key: Column, width: int) -> Column:
    """The segment itself and, for each of its 0 bits, the segment with that bit set."""
    bits = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), b) for b in range(width)))
    clear = F.filter(bits, lambda bit: key.bitwiseAND(bit) == 0)
    return F.transform(
        clear, lambda bit: F.struct(F.lit(segment).alias("segment"), key.bitwiseOR(bit).alias("key"), (bit == 0).alias("same"))
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints of column ``fp`` at most ``max_bits`` apart.

    64 bits are cut into max_bits // 2 + 1 segments, so that two fingerprints
    in reach differ by one bit or none in some segment. Every fingerprint is
    filed under each of its segments, and looks up the Hamming ball of radius
    one around each. Of two segments that differ by one bit, the one with the
    0 finds the other, which halves the ball. Matches are verified on all bits.
    ``prints`` holds each fingerprint once, so copies cost nothing here.

    Spark sizes a table after an explode like the one before it, so the join
    is merged: a ball is some 17 rows a segment, and broadcast by that size
    they would not fit the driver.
    """
    count = max_bits // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    segments, balls = [], []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        mask = F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("long")
        key = F.shiftrightunsigned("fp", low).bitwiseAND(mask)
        segments.append(F.struct(F.lit(i).alias("segment"), key.alias("key")))
        balls.append(_ball(i, key, high - low if max_bits else 0))
    filed = prints.select(F.col("fp").alias("a"), F.explode(F.array(*segments)).alias("s")).select("a", "s.segment", "s.key")
    probes = prints.select(F.col("fp").alias("b"), F.explode(F.flatten(F.array(*balls))).alias("s")).select("b", "s.segment", "s.key", "s.same")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    found = filed.join(probes.hint("merge"), ["segment", "key"]).where((F.col("a") != F.col("b")) & once & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``prints`` (doc_id, fp).

    ``root`` is the smallest fingerprint the links reach, ``component_id`` the
    smallest doc_id, nulls left out. A row for each fingerprint, so it is to
    be merged with ``prints``, of which a file shows a fraction of the size.
    """
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"), max_bits))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def groups(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text, ...).

    A group is what links reach; its id is the smallest doc_id in it, nulls
    left out (null only if all its ids are). Texts without words share the
    fingerprint 0 and are linked like any other. Repeated rows give a row
    each, an empty table gives none, other columns of ``docs`` are not read.
    """
    prints = stored(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    return prints.join(classes(prints, max_bits).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` left when one document of each group stays: the one with the smallest doc_id.

    Where rows share that id the one with the smallest fingerprint stays, any
    of equal rows. A group whose ids are all null keeps one row. Columns are
    unchanged.
    """

    key = row_key(docs)
    prints = docs.select("doc_id", key.alias("row"), fingerprints(F.col("text"), shingle).alias("fp"))
    prints = stored(prints, "simhash")
    grouped = prints.join(classes(prints.select("doc_id", "fp"), max_bits).hint("merge"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = grouped.groupBy("root", "component_id").agg(F.min(F.struct("fp", "row")).alias("least")).select(F.col("least.row").alias("__row"))
    marked = docs.select(*docs.columns, key.alias("__row"))
    return marked.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
