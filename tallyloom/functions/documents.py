"""Rules for analysed documents: names, ids, normal form, text to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import constants as C


def stem(filename: Column) -> Column:
    """Last path part without its last extension."""
    return F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def parse_image_name(filename: Column, brand: Column) -> Column:
    """Struct (brand, gender, category, product_code) of a strict image name, with fallbacks."""
    name = stem(filename)
    hit = name.rlike(C.IMAGE_NAME)

    def part(i: int) -> Column:
        return F.regexp_extract(name, C.IMAGE_NAME, i)

    return F.struct(
        F.when(hit, part(1)).otherwise(brand).alias("brand"),
        F.when(hit, part(2)).otherwise("unknown").alias("gender"),
        F.when(hit, part(3)).otherwise("unknown").alias("category"),
        F.when(hit, part(4)).otherwise(F.element_at(F.split(name, "_"), -1)).alias("product_code"),
        hit.alias("matched"),
    )


def parse_image_name_lenient(filename: Column) -> Column:
    """Struct by position on '_' before the first '.', missing parts 'Unknown'."""
    parts = F.split(F.substring_index(filename, ".", 1), "_")

    def part(i: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("Unknown"))

    return F.struct(
        part(1).alias("brand"),
        part(2).alias("gender"),
        part(3).alias("category_code"),
        part(4).alias("product_code"),
        F.concat_ws("_", part(1), part(4)).alias("product_id"),
    )


def code_from_filename(filename: Column) -> Column:
    """Last '_' token, or the one before it where the last is a one or two digit counter."""
    parts = F.split(stem(filename), "_")
    last = F.element_at(parts, -1)
    counter = (F.size(parts) >= 2) & last.rlike(r"^\d{1,2}$")
    return F.when(counter, F.try_element_at(parts, F.lit(-2))).otherwise(last)


def build_product_id(brand: Column, code: Column) -> Column:
    trimmed = F.trim(brand)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", code).otherwise(F.concat_ws("_", trimmed, code))


def is_error_doc(error: Column) -> Column:
    return error.isNotNull()


def normalise_doc(docs: DataFrame, id_field: str = "product_id", derive_id: bool = True) -> DataFrame:
    """Lift nested info to the top level, fill code, id and file name where absent, drop ``_id``.

    A column the input lacks counts as absent, and so does NULL.
    """
    have = set(docs.columns)
    info = {f.name for f in docs.schema["basic_info"].dataType.fields} if "basic_info" in have else set()

    def top(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    def lifted(name: str, nested: str) -> Column:
        return F.coalesce(top(name), F.col(f"basic_info.{nested}")) if nested in info else top(name)

    out = docs.withColumns(
        {
            "brand": lifted("brand", "brand"),
            "gender": lifted("gender", "gender"),
            "category": lifted("category", "original_category"),
        }
    )
    if "basic_info" in have:
        fields = docs.schema["basic_info"].dataType.fields
        nested = [
            f.name
            for f in fields
            if f.name in ("origin_hdfs_path", "image_path") and isinstance(f.dataType, (T.StructType, T.MapType))
        ]
        for name in nested:
            out = out.withColumn("basic_info", F.col("basic_info").withField(name, F.to_json(F.col(f"basic_info.{name}"))))
    name = F.nullif(F.trim(top("filename")), F.lit(""))
    out = out.withColumn("product_code", F.coalesce(top("product_code"), code_from_filename(name)))
    if derive_id:
        derived = F.when(F.col("product_code").isNotNull(), build_product_id(F.col("brand"), F.col("product_code")))
        out = out.withColumn(id_field, F.coalesce(top(id_field), derived))
    return out.withColumn("image_filename", F.coalesce(top("image_filename"), name)).drop("_id")


def embedding_text(brand: Column, gender: Column, category: Column, occasions: Column, description: Column) -> Column:
    return F.format_string(
        C.EMBEDDING_TEMPLATE,
        *[F.coalesce(c, F.lit("None")) for c in (brand, gender, category)],
        F.coalesce(F.array_join(occasions, ", "), F.lit("")),
        F.coalesce(description, F.lit("")),
    )
