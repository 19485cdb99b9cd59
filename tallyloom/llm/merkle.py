"""Merkle manifest of a dataset: trees over each source's documents, labelled with nested intervals of leaf ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored
from tallyloom.operators.sequence import assign_sequence

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEP = "struct<left: string, right: string>"


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text."""
    return F.sha2(text.cast("binary"), 256)


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a document's fields, each with its length in bytes; ``text`` in place of the stored one."""

    def field(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name)
        value = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*[field(name) for name in FIELDS]))


def tree_key(source: Column) -> Column:
    """A key without nulls, null first, the rest in the order of their bytes."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("S"), source.cast("string")))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, by ``order``) and ``size`` of each ``tree``; a hot tree spreads over partitions."""
    numbered = stored(assign_sequence(rows, order, "tree", name="rank"), "ranked")
    sizes = stored(numbered.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "sizes")  # known to be small, or not
    return numbered.join(sizes, "tree").withColumn("rank", F.col("rank") - 1)


def _joined_hashes(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda c: c.hash), "")


def grown(leaves: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The nodes above ``leaves`` (tree, size, rank, hash, payload ...), a table per level from 1 up.

    A node covers the leaf ranks ``lo`` to ``hi`` of its tree, and holds its
    children, at most ``FANOUT``, in order: (lo, hi, hash) and on level 1 the
    leaves' payload. A tree ends at the level where one node covers it; a lone
    leaf is its own root. Each level is one exchange of the level below, whose
    groups are never larger than ``FANOUT``.
    """
    low = F.struct(F.col("rank").alias("lo"), F.col("rank").alias("hi"), "hash", *payload)
    below, levels, depth = leaves.select("tree", "size", low.alias("node")), [], 1
    while True:
        span = FANOUT**depth
        bucket = F.expr(f"node.lo div {span}").alias("bucket")
        runs = below.groupBy("tree", "size", bucket).agg(F.array_sort(F.collect_list("node")).alias("children"))
        hashed = digest(_joined_hashes(F.col("children")))
        nodes = runs.select(
            "tree",
            "size",
            "bucket",
            F.get("children", F.lit(0)).lo.alias("lo"),
            F.element_at("children", -1).hi.alias("hi"),
            F.when(F.col("size") == 1, F.get("children", F.lit(0)).hash).otherwise(hashed).alias("hash"),
            "children",
        )
        levels.append(stored(nodes, f"merkle-{depth}"))
        above = levels[-1].where(F.col("size") > span)
        if above.isEmpty():
            return levels
        below, depth = above.select("tree", "size", F.struct("lo", "hi", "hash").alias("node")), depth + 1


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash): the one node that covers each tree, from the level where it first does."""
    found = None
    for depth, nodes in enumerate(levels, start=1):
        top = nodes.where(F.col("size") <= FANOUT**depth).select("tree", "hash")
        found = top if found is None else found.unionByName(top)
    return found


def _step(children: Column, lo: Column, hi: Column) -> Column:
    """What of the parent's interval lies beside (lo, hi): the siblings to the left and to the right."""
    left = F.filter(children, lambda c: c.hi < lo)
    right = F.filter(children, lambda c: c.lo > hi)
    return F.array(F.struct(_joined_hashes(left).alias("left"), _joined_hashes(right).alias("right")))


def proofs(levels: list[DataFrame], tops: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, lo, hash, payload ..., top, path) for every leaf.

    ``tops`` (tree, top, path) holds what stands above each tree. ``path`` has
    a step (left, right) for each level from the leaf up: the joined hashes of
    its siblings on either side. Nodes meet their parents, level by level from
    the top, in the parent's bucket, where the parent's interval contains
    theirs. No parent has more than ``FANOUT`` children, so no key is hot; a
    tree's top meets ``tops`` once. The leaves come out of their run's row.
    """
    above = None
    for depth in range(len(levels), 0, -1):
        nodes = levels[depth - 1]
        own = nodes.where(F.col("size") <= FANOUT**depth).join(tops, "tree")
        if above is not None:
            parents = above.select(
                "tree",
                F.col("bucket").alias("parent"),
                F.col("lo").alias("parent_lo"),
                F.col("hi").alias("parent_hi"),
                F.col("children").alias("family"),
                "top",
                F.col("path").alias("upper"),
            )
            inside = nodes.where(F.col("size") > FANOUT**depth).withColumn("parent", F.expr(f"bucket div {FANOUT}")).join(parents, ["tree", "parent"])
            inside = inside.where("parent_lo <= lo and hi <= parent_hi")
            path = F.concat(_step(F.col("family"), F.col("lo"), F.col("hi")), "upper")
            own = own.unionByName(inside.withColumn("path", path).select(own.columns))
        above = own
    each = above.select("tree", "size", "top", "path", "children", F.explode("children").alias("c"))
    path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(_step(F.col("children"), F.col("c.lo"), F.col("c.hi")), "path"))
    return each.select("tree", "c.lo", "c.hash", *[f"c.{p}" for p in payload], "top", path.alias("path"))


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, joined: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s.left, node, s.right)))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) per document.

    Every source's documents, in order of doc_id, are the leaves of a tree;
    the sources' roots, null first, are the leaves of the topmost. Where
    ``tampered`` holds, the leaf that is folded is made with ``changed`` as its
    text, and should not verify if that differs.

    Null fields are written ``-``; a null id comes first and is not tampered
    with by a null condition. Rows that share an id stand side by side in
    order of their leaves, repeated rows each have a leaf; an empty table
    gives no rows. Other columns are not read.
    """
    kept = docs.select(*[F.col(c) for c in FIELDS])
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(kept, changed))
    rows = kept.select(F.col("doc_id").cast("long").alias("doc_id"), tree_key(F.col("source")).alias("tree"), leaf(kept).alias("hash"), other.alias("other"))
    # Repeated rows are told apart by their place in the stored table, so that ranges can part them.
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    payload = ["doc_id", "other"]
    levels = grown(ranked(rows, ["doc_id", "hash", "tie"]), payload)
    subroots = stored(roots(levels).withColumnRenamed("tree", "source_key"), "subroots")
    upper = grown(ranked(subroots.withColumn("tree", F.lit("")), ["source_key"]), ["source_key"])
    crown = roots(upper).select("tree", F.struct(F.col("hash").alias("root")).alias("top"), F.array().cast(f"array<{STEP}>").alias("path"))
    tops = proofs(upper, crown, ["source_key"])
    tops = tops.select(F.col("source_key").alias("tree"), F.struct(F.col("hash").alias("subroot"), "top.root").alias("top"), "path")
    leaves = proofs(levels, stored(tops, "tops"), payload)
    root = folded(F.coalesce("other", "hash"), F.col("path"))
    found = leaves.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "top.subroot",
        "top.root",
        "path",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        root.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
