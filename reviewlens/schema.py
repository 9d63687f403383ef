"""The review table: column names, types and fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order and names of a review file.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("marketplace", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_parent", T.StringType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("star_rating", T.IntegerType()),
        T.StructField("helpful_votes", T.IntegerType()),
        T.StructField("total_votes", T.IntegerType()),
        T.StructField("vine", T.StringType()),
        T.StructField("verified_purchase", T.StringType()),
        T.StructField("review_headline", T.StringType()),
        T.StructField("review_body", T.StringType()),
        T.StructField("review_date", T.DateType()),
    ]
)

# The ratings a review can carry.
STARS = (1, 2, 3, 4, 5)

# Headlines filled in for customers who wrote none.
DEFAULT_HEADLINES = ("One Star", "Two Stars", "Three Stars", "Four Stars", "Five Stars")


@dataclass(frozen=True)
class Counted:
    """Marks rows that stand for several reviews or words each and carry their number: a cube of
    `rating_cube`, counts of `category_counts` or of `word_counts`. A frame without the mark has one row
    per review, whatever its columns are called."""

    rows: DataFrame


def is_rating(star: Column) -> Column:
    """True for one to five stars; null for an unrated review."""
    return star.between(STARS[0], STARS[-1])


def conform(df: DataFrame) -> DataFrame:
    """The review columns of `df`, in order and with their declared types.

    A missing column is an error here, because a reader given a schema would fill it with nulls.
    """
    missing = [f.name for f in REVIEW_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"not a review table, columns missing: {', '.join(missing)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEW_SCHEMA])
