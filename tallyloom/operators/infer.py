"""Batch inference: skip what is done, load a model once per worker, work by Arrow batch.

Models are passed in as factories and built inside the task. Without one,
words are hashed in the JVM, so results do not depend on a model download.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import constants as C
from tallyloom.functions.detection import category_map, clamp_bbox
from tallyloom.functions.text import extract_json_payload

Encoder = Callable[[list], np.ndarray]


def hashed_vectors(
    df: DataFrame, key: str, source: str, dims: int = 64, done: DataFrame | None = None, output: str = "text_vector"
) -> DataFrame:
    """(key, vector) of the rows whose key is not in ``done``: signed feature hashing of lower-cased words, unit length.

    Built-in functions alone. Words are folded to one sum per row and cell
    before the shuffle, so a long text moves at most ``dims`` numbers. A text
    without words has the zero vector; ``key`` has to be unique.
    """
    todo = df if done is None else df.join(done.select(key), key, "left_anti")
    words = todo.select(key, F.explode_outer(F.split(F.trim(F.lower(F.coalesce(source, F.lit("")))), r"\s+")).alias("w"))
    digest = F.md5(F.col("w"))
    cell = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.substring(digest, 10, 1).isin(*"13579bdf"), 1).otherwise(-1)
    hashed = words.select(key, cell.alias("cell"), F.when(F.col("w") == "", 0).otherwise(sign).alias("sign"))
    sums = hashed.groupBy(key, "cell").agg(F.sum("sign").alias("v"))
    cells = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"), F.sum(F.col("v") * F.col("v")).alias("square"))
    length = F.sqrt(F.col("square").cast("double"))
    value = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.when(F.col("square") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0)) / length).otherwise(0.0).cast("float"),
    )
    return cells.select(key, value.alias(output))


def embed(
    df: DataFrame,
    key: str,
    source: str,
    make_encoder: Callable[[], Encoder],
    done: DataFrame | None = None,
    output: str = "text_vector",
    as_of: Column | None = None,
) -> DataFrame:
    """(key, vector, embedded_at) of the rows whose key is not in ``done``."""
    todo = df if done is None else df.join(done.select(key), key, "left_anti")
    todo = todo.select(key, F.col(source).alias("__in"))
    schema = T.StructType([todo.schema[key], T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            vectors = encode(batch["__in"].tolist())
            yield pd.DataFrame({key: batch[key], output: [v.astype(np.float32) for v in vectors]})

    return todo.mapInPandas(run, schema).withColumn("embedded_at", F.current_timestamp() if as_of is None else as_of)


def detect(images: DataFrame, make_detector: Callable[[], Callable], threshold: float = 0.25) -> DataFrame:
    """One row per detected box, clipped and mapped to a category.

    ``images`` has the columns (path, content); the detector maps bytes to
    (width, height, [(class, confidence, x1, y1, x2, y2)]).
    """
    schema = (
        "path string, box int, class_name string, confidence double, "
        "x1 int, y1 int, x2 int, y2 int, width int, height int"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                width, height, boxes = detector(content)
                rows += [(path, i, *box, width, height) for i, box in enumerate(boxes)]
            yield pd.DataFrame(
                rows,
                columns=["path", "box", "class_name", "confidence", "x1", "y1", "x2", "y2", "width", "height"],
            )

    raw = images.select("path", "content").mapInPandas(run, schema).filter(F.col("confidence") >= threshold)
    return clamp_bbox(raw).withColumn("category", category_map(F.col("class_name")))


def describe(
    items: DataFrame, key: str, source: str, make_generator: Callable[[], Callable], done: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Generated JSON descriptions and, apart, the rows whose answer held none."""
    todo = items if done is None else items.join(done.select(key), key, "left_anti")
    todo = todo.select(key, source)
    schema = T.StructType([todo.schema[key], T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "answer": [generate(v) for v in batch[source]]})

    answers = todo.mapInPandas(run, schema).withColumn("analysis", extract_json_payload(F.col("answer")))
    return answers.filter(F.col("analysis").isNotNull()).select(key, "analysis"), answers.filter(
        F.col("analysis").isNull()
    ).select(key, "answer")


def sync_docs(docs: DataFrame, brand: str) -> DataFrame:
    """Documents of a brand with at least one vector, in the search schema."""
    return docs.filter(
        (F.col("basic_info.brand") == brand.lower())
        & (F.col("text_vector").isNotNull() | F.col("image_vector").isNotNull())
    ).select(
        F.col("product_id").cast("string").alias("id"),
        "filename",
        F.coalesce("basic_info.brand", F.lit(brand.lower())).alias("brand"),
        F.col("basic_info.original_category").alias("category"),
        F.coalesce("analysis.description", F.lit("")).alias("description"),
        F.col("filename").alias("image_url"),
        F.col("image_vector").alias("vec_image"),
        F.col("text_vector").alias("vec_text"),
    )


def dedupe_by_content(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One file per content digest, the smallest key; combined map-side, content itself is not shuffled."""
    digest = F.md5(F.col(content))
    return files.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def large_enough(files: DataFrame) -> DataFrame:
    return files.filter(F.col("length") >= C.MIN_IMAGE_BYTES)
