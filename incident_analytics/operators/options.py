"""Filter options: distinct categories (with display labels) and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES
from .summary import has_coords

# Display label and colour per category.
CATEGORY_INFO = [
    ("PERSON", "Person", "#dc3545"),
    ("PROPERTY", "Property", "#ffc107"),
    ("SOCIETY", "Society", "#17a2b8"),
    ("ANY", "Any", "#9b59b6"),
    ("NOT_A_CRIME", "Not a Crime", "#6c757d"),
]
DEFAULT_COLOR = "#6c757d"


def category_labels(spark: SparkSession) -> DataFrame:
    """The five-row label table (a bounded dimension, safe to broadcast)."""
    return spark.createDataFrame(CATEGORY_INFO, "category STRING, label STRING, color STRING")


def category_options(df: DataFrame) -> DataFrame:
    """Distinct non-null categories with label and colour; unknown categories
    label as themselves. Falls back to the three main categories when the
    table has none. Every row is read, once: the fallback is applied to the
    distinct categories, a handful."""
    found = (df.where(has_coords(df)).select(F.col("crime_against_category").alias("category"))
             .where(F.col("category").isNotNull()).distinct())
    listed = found.agg(F.collect_set("category").alias("all"))
    fallback = F.array(*[F.lit(c) for c in CATEGORIES])
    cats = listed.select(F.explode(F.when(F.size("all") > 0, F.col("all")).otherwise(fallback)).alias("category"))
    labels = category_labels(df.sparkSession)
    return (cats.join(F.broadcast(labels), "category", "left")
            .select("category",
                    F.coalesce("label", "category").alias("label"),
                    F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"))
            .orderBy("category"))


def area_options(df: DataFrame) -> DataFrame:
    """Distinct non-null areas, sorted."""
    return (df.where(has_coords(df)).select("area").where(F.col("area").isNotNull()).distinct().orderBy("area"))
