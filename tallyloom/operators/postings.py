"""Positional postings: where each word stands in each document, stored by word."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.versioned import PartTable, bucket

PARTS = 64


def postings(docs: DataFrame, doc: str, text: str, pattern: str = r"\w+") -> DataFrame:
    """(word, doc, position, gap): every word of the lower-cased texts, with what stands between it and the word before."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(f"({pattern})"), F.lit(1))
    pairs = docs.select(F.col(doc).alias("doc"), F.posexplode(F.arrays_zip(words.alias("word"), F.slice(F.split(lowered, pattern), F.lit(1), F.size(words)).alias("gap"))))
    return pairs.select("col.word", "doc", F.col("pos").alias("position"), "col.gap")


def build_postings(docs: DataFrame, doc: str, text: str, root: str, pattern: str = r"\w+", parts: int = PARTS) -> PartTable:
    """Postings stored below ``root``, a part for each of ``parts`` hash ranges of words, sorted by word."""
    table = PartTable(docs.sparkSession, root, bucket(["word"], parts), order=["word", "doc", "position"])
    table.create(postings(docs, doc, text, pattern))
    return table


def add_documents(table: PartTable, docs: DataFrame, doc: str, text: str, batch: str, pattern: str = r"\w+") -> int:
    """Add the words of further documents; a repeated batch changes nothing."""
    return table.apply(postings(docs, doc, text, pattern), lambda old, new: old.unionByName(new), batch)


def _of(table: PartTable, words: Sequence[str]) -> DataFrame:
    """The postings of some words; only the parts that hold them are read."""
    asked = table.spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    return table.read_keys(asked).filter(F.col("word").isin(sorted(set(words))))


def phrase_documents(table: PartTable, phrase: str) -> DataFrame:
    """(doc): documents that hold the phrase between word boundaries, whatever the case.

    Words have to follow each other with the phrase's own characters between
    them; their places are joined, texts are not read. The phrase begins and
    ends with a word.
    """
    parts = re.findall(r"(\W*)(\w+)", phrase.lower(), re.ASCII)
    if "".join(gap + word for gap, word in parts) != phrase.lower() or parts[0][0]:
        raise ValueError("a phrase begins and ends with a word")
    found = None
    for i, (gap, word) in enumerate(parts):
        rows = _of(table, [word]).filter(F.col("word") == word)
        if i:
            rows = rows.filter(F.col("gap") == gap)
        starts = rows.select("doc", (F.col("position") - i).alias("start"))
        found = starts if found is None else found.join(starts, ["doc", "start"], "left_semi")
    return found.select("doc").distinct()


def matched_words(table: PartTable, words: Sequence[str]) -> DataFrame:
    """(doc, score): how many of the words each document holds, of those that hold any."""
    return _of(table, [w.lower() for w in words]).groupBy("doc").agg(F.count_distinct("word").cast("int").alias("score"))
