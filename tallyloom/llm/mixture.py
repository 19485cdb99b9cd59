"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, id_block, row_key, running_total, source_key, stored

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
SHARE = 1.5  # words of the mix, as a share of all words
MOST = 2  # times a source's words its target may be
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every document; a null text has none."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", source_key(F.col("source")).alias("source"), words.alias("size"))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): words of the mix from each source.

    Sharing by weight, with the excess above ``most`` times a source's size
    shared again by weight until none is above, ends with every source at
    min(most * size, weight * level) for one level. With sources in order of
    size / weight, the level is the largest of what is left for a source and
    those after it, per weight of theirs. One row per source meets here, no
    documents.
    """
    rank = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("most") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    rows = rows.withColumn("level", left / heavy).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    A document's expected copies are target / size of its source. Documents of
    a source are laid end to end by expected copies, behind one random offset
    of the source; each is taken once for every integer boundary it crosses.
    They lie in order of size (two leading digits), so that every size is hit
    evenly and the words taken come near the target. The place of a document
    among its source's is counted in two levels of at most 256 blocks: no task
    holds a source. Integer counts and a digest of the seed make reruns agree.

    Null texts have size 0, null sources are one source, ties and repeated
    rows fall to doc_id and then share their boundaries; an empty table gives
    no rows.
    """
    digits = F.col("size").cast("string")
    band = F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")
    rows = sizes(docs).withColumn("band", band).withColumn("block", id_block(F.col("doc_id"))).withColumn("one", F.lit(1))
    rows = stored(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    bands = rows.groupBy("source", "band").agg(F.sum("one").alias("n"))
    smaller = F.sum("n").over(Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.select("source", "band", F.coalesce(smaller, F.lit(0)).alias("smaller"))
    placed = running_total(rows, ["source", "band"], "block", ["size", "doc_id"], "one", "within")
    placed = placed.join(bands, ["source", "band"]).join(targets(totals, **options), "source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "source").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("smaller") + F.col("within")).cast("double")

    def crossed(to: Column) -> Column:
        return F.floor(rate * to + offset)

    taken = crossed(place + 1) - crossed(place)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged.

    Equal rows are drawn one by one and come back as one row with their
    copies; rows with one id that differ are documents of their own.
    """
    keyed = docs.withColumn("__row", row_key(docs))
    drawn = copies(keyed.select(F.col("__row").alias("doc_id"), "source", "text"), **options)
    often = drawn.groupBy("doc_id").agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    taken = keyed.join(often.withColumnRenamed("doc_id", "__row"), "__row").dropDuplicates(["__row"])
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
