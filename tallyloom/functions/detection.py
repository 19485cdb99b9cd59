"""Detector output: class names and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.constants import DETECTED_CATEGORY
from tallyloom.functions.text import literal_map


def category_map(class_name: Column, pass_through: bool = False) -> Column:
    """Top, Bottom or Outer; unknown classes are NULL, or kept as they are."""
    mapped = F.try_element_at(literal_map(DETECTED_CATEGORY), F.lower(F.trim(class_name)))
    return F.coalesce(mapped, class_name) if pass_through else mapped


def clamp_bbox(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Clip x1, y1, x2, y2 to the image, drop empty boxes, add w and h."""

    def clip(value: str, top: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(value), top))

    clipped = boxes.withColumns(
        {
            "x1": clip("x1", F.col(width) - 1),
            "x2": clip("x2", F.col(width)),
            "y1": clip("y1", F.col(height) - 1),
            "y2": clip("y2", F.col(height)),
        }
    )
    return clipped.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumns(
        {"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    )
