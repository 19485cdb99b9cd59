"""Vector columns: norms, products, field detection, dimension checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(left), as_double(right), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(vector)
    return F.when(length > 0, F.transform(as_double(vector), lambda x: x / length)).otherwise(as_double(vector))


def detect_vector_fields(schema: T.StructType, wanted: Sequence[str] | None = None) -> list[str]:
    """Numeric array fields named ``*_vector``, else ``embedding``; an error without any."""
    if wanted:
        return list(wanted)

    def numeric(field: T.StructField) -> bool:
        return isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType)

    found = [f.name for f in schema.fields if f.name.endswith("_vector") and numeric(f)]
    if not found:
        found = [f.name for f in schema.fields if f.name == "embedding" and numeric(f)]
    if not found:
        raise ValueError("no vector field: name the fields or add a numeric '*_vector' array")
    return found


def dimension_report(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows per field and length, with absent, empty and NULL-holding vectors told apart.

    One scan, one map-side combined aggregation, independent of row order.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.when(F.col(f).isNull(), "absent")
                    .when((F.size(f) == 0) | F.exists(f, lambda x: x.isNull()), "invalid")
                    .otherwise("present")
                    .alias("state"),
                    F.when(F.col(f).isNotNull(), F.size(f)).alias("dims"),
                )
                for f in fields
            ]
        )
    )
    return df.select(pairs.alias("v")).groupBy("v.field", "v.state", "v.dims").agg(F.count("*").alias("rows"))


def validate_dims(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: is every present vector valid, and are all of one length?"""
    present = F.col("state") == "present"
    return (
        dimension_report(df, fields)
        .groupBy("field")
        .agg(
            F.sum(F.when(F.col("state") == "absent", F.col("rows")).otherwise(0)).alias("absent"),
            F.sum(F.when(F.col("state") == "invalid", F.col("rows")).otherwise(0)).alias("invalid"),
            F.sum(F.when(present, F.col("rows")).otherwise(0)).alias("present"),
            F.min(F.when(present, F.col("dims"))).alias("min_dims"),
            F.max(F.when(present, F.col("dims"))).alias("max_dims"),
        )
        .withColumn("valid", (F.col("invalid") == 0) & (F.coalesce(F.col("min_dims") == F.col("max_dims"), F.lit(True))))
    )
