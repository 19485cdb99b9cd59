"""Order MinHash fingerprints, sensitive to edit distance, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

TOKEN = r"[^\x20\x09-\x0D]{1,8}"  # words; longer runs are cut, so texts without spaces have tokens too
BINS = 64  # tuples of a fingerprint
LOWEST = -(1 << 63)  # stands in for a null id, which comes first
HASH_BITS, PLACE_BITS = 34, 29


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) without nulls in key and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def successors(rows: DataFrame) -> DataFrame:
    """(key, next_key, half): the key after each key, the first after the last.

    ``half`` is the most code points a document of the key replaces. Keys are
    ranged over partitions; within one the next row is looked up, and one row
    per partition, which is all that is broadcast, bridges to the partition
    behind.
    """
    keys = rows.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    keys = stored(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    order = Window.orderBy("part")
    firsts = keys.groupBy("part").agg(F.min("key").alias("first"))
    bridge = firsts.select(
        "part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bridge")
    )
    own = keys.withColumn("own", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return own.join(F.broadcast(bridge), "part").select("key", F.coalesce("own", "bridge").alias("next_key"), "half")


def edited(rows: DataFrame, following: DataFrame) -> DataFrame:
    """Add ``copy`` (rows of one key are numbered) and ``edited`` to ``rows``.

    The last half of a text gives way to the beginning of the next document,
    the first row of the next key. The texts are shuffled once; only the part
    of the next text that is needed moves a second time.
    """
    order = Window.partitionBy("key").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("copy", F.count(F.lit(1)).over(order).cast("int"))
    wanted = following.select("next_key", F.col("key").alias("for_key"), "half")
    starts = own.where("copy = 1").join(wanted, F.col("key") == F.col("next_key"))
    starts = starts.select(F.col("for_key").alias("key"), F.expr("substring(text, 1, half)").alias("start"))
    joined = own.join(starts, "key")
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - half)
    return joined.select("doc_id", "key", "copy", "text", F.concat(kept, F.substring("start", F.lit(1), half)).alias("edited"))


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One array column ``fp_<text>`` for each column of ``texts``, for each row of ``rows``, named by ``keys``.

    A k-mer is two neighbouring tokens (the first and the last also stand with
    the text's edge), and carries the number of its occurrence in the text. A hash of both picks a
    bin; in each half of a bin the k-mer with the smallest hash is selected.
    The two keep the order they have in the text, and a hash of the ordered
    pair is the bin's entry: bin * 2^16 + 16 bits. Fewer k-mers leave bins
    empty; a text without tokens has an empty array.

    ``rows`` should be distributed by the first of ``keys``: numbering and both
    aggregations then need no further shuffle.
    """
    sides = F.array(*(F.struct(F.lit(i).cast("byte").alias("side"), F.col(t).alias("body")) for i, t in enumerate(texts)))
    each = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.side", F.regexp_extract_all("s.body", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    first = F.when(F.size("tokens") > 0, F.array(F.xxhash64(F.lit("first"), F.get("tokens", F.lit(0))))).otherwise(F.array().cast("array<long>"))
    pairs = F.transform("tokens", lambda x, i: F.xxhash64(x, F.get("tokens", i + 1)))
    grams = each.select(*keys, "side", F.concat(first, pairs).alias("grams"))
    grams = grams.select(*keys, "side", F.posexplode_outer("grams").alias("place", "gram"))
    numbered = grams.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "side", "gram").orderBy("place")))
    hashed = numbered.withColumn("hash", F.when(F.col("gram").isNotNull(), F.xxhash64("gram", "occurrence")))
    spot = F.col("hash").bitwiseAND(F.lit(2 * BINS - 1).cast("long"))
    code = F.shiftleft(F.shiftrightunsigned("hash", 64 - HASH_BITS), PLACE_BITS).bitwiseOR(F.col("place").cast("long"))
    coded = hashed.select(*keys, "side", F.shiftright(spot, 1).cast("int").alias("bin"), (spot % 2).alias("part"), code.alias("code"))
    least = coded.groupBy(*keys, "side", "bin").agg(
        F.min(F.when(F.col("part") == 0, F.col("code"))).alias("a"), F.min(F.when(F.col("part") == 1, F.col("code"))).alias("b")
    )
    where = F.lit((1 << PLACE_BITS) - 1).cast("long")
    a, b = F.shiftright("a", PLACE_BITS), F.shiftright("b", PLACE_BITS)
    swapped = F.col("a").bitwiseAND(where) > F.col("b").bitwiseAND(where)
    pair = F.when(swapped, F.xxhash64(b, a, F.lit(1))).otherwise(F.xxhash64(a, b, F.lit(0)))
    entry = (F.col("bin") * 65536 + pair.bitwiseAND(F.lit(65535).cast("long")).cast("int")).cast("int")
    whole = least.withColumn("entry", entry).groupBy(*keys, "side").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    columns = [F.first(F.when(F.col("side") == i, F.col("entries")), True).alias(f"fp_{t}") for i, t in enumerate(texts)]
    return whole.groupBy(*keys).agg(*columns)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins that either fingerprint fills; 1 for two empty ones."""

    def bins(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.shiftright(e, 16))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def written(entries: Column) -> Column:
    """A fingerprint as text: six hexadecimal digits an entry."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and the next text's.

    Null texts are empty, null ids one id before all others, repeated ids
    documents of their own (the next document is then the first by text);
    repeated rows give equal rows, a single document is its own next, an empty
    table gives no rows. Other columns are not read.
    """
    rows = keyed(docs)
    following = successors(rows)
    pairs = edited(rows, following)
    facts = pairs.select("doc_id", "key", "copy", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    prints = stored(facts.join(fingerprints(pairs, ["key", "copy"], ["text", "edited"]), ["key", "copy"]), "ordermin")
    beside = prints.where("copy = 1").select(F.col("key").alias("next_key"), F.col("fp_text").alias("fp_next"))
    joined = prints.join(following.select("key", "next_key"), "key").join(beside, "next_key")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("fp_text")).alias("fingerprint"),
        written(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"),
        likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"),
    )
