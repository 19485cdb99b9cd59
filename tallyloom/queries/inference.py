"""Vectors of texts without a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import infer as I
from tallyloom.plans import domain as D
from tallyloom.queries import register


@register(
    "embed_texts",
    r"""WITH words AS (SELECT doc_id, unnest(string_split_regex(trim(lower(text)), '\s+')) AS w FROM documents ANTI JOIN labels USING (doc_id)),
cells AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % 32 AS cell, sum(CASE WHEN contains('13579bdf', substr(md5(w), 10, 1)) THEN 1 ELSE -1 END) AS v FROM words WHERE w <> '' GROUP BY 1, 2)
SELECT doc_id, CAST(32 AS INTEGER) AS dims, count(*) FILTER (WHERE v <> 0) AS nonzero, count(*) FILTER (WHERE v > 0) AS positive, CASE WHEN max(v) > 0 THEN CAST(arg_max(cell, (v, -CAST(cell AS BIGINT))) AS INTEGER) END AS largest
FROM cells GROUP BY 1""",
)
def embed_texts(spark, d):
    """Documents that carry no label yet are embedded; the vector's shape is what SQL can see."""
    docs, done = D.table(spark, d, "documents"), D.table(spark, d, "labels")
    out = I.hashed_vectors(docs, "doc_id", "text", 32, done)
    v = F.col("text_vector")
    return out.select(
        "doc_id",
        F.size(v).alias("dims"),
        F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("nonzero"),
        F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"),
        F.when(F.array_max(v) > 0, F.array_position(v, F.array_max(v)) - 1).cast("int").alias("largest"),
    )
