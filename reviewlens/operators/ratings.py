"""Reports on ratings and votes.

Each takes reviews, or `Counted` rows of the cube that `rating_cube` returns, so that a run of many
reports reads the reviews once. Each is one aggregation with map-side partials: however uneven the
categories, a task ships one row per group it saw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.schema import STARS, Counted, is_rating

CUBE_KEYS = ("marketplace", "product_category", "star_rating", "verified_purchase", "vine")

# Columns of a cube in place of one row per review.
N = "n_reviews"
N_VOTED = "n_voted"
HELPFUL_SHARE = "helpful_share"


def _weighted(df: DataFrame | Counted) -> DataFrame:
    """Reviews with the weight a cube's rows have: one review each."""
    return df.rows if isinstance(df, Counted) else df.withColumn(N, F.lit(1).cast("bigint"))


def _with_shares(df: DataFrame | Counted) -> DataFrame:
    """Reviews with the sums a cube's rows have: their own share of helpful votes, and whether there is one."""
    weighted = _weighted(df)
    if isinstance(df, Counted):
        return weighted
    share = F.when(F.col("total_votes") != 0, F.col("helpful_votes") / F.col("total_votes"))
    return weighted.withColumns({HELPFUL_SHARE: share, N_VOTED: share.isNotNull().cast("bigint")})


def rating_cube(reviews: DataFrame | Counted, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """Counts and vote sums per combination of `keys`: at most a few thousand rows for any input."""
    sums = (N, N_VOTED, HELPFUL_SHARE, "helpful_votes", "total_votes")
    return _with_shares(reviews).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def in_marketplace(df: DataFrame | Counted, marketplace: str = "US") -> DataFrame | Counted:
    """Reviews of one marketplace; the comparison reaches a Parquet scan."""
    if isinstance(df, Counted):
        return Counted(in_marketplace(df.rows, marketplace))
    return df.where(F.col("marketplace") == marketplace)


def _mean_rating(where: Column | None = None) -> Column:
    """Mean rating of the rated reviews (that satisfy `where`); null if there are none."""
    rated = F.col("star_rating").isNotNull()
    rated = rated if where is None else rated & where
    stars = F.sum(F.when(rated, F.col("star_rating") * F.col(N)))
    return stars / F.sum(F.when(rated, F.col(N)))


def _is(flag: str, value: str) -> Column:
    return F.col(flag) == value


def distinct_categories(df: DataFrame | Counted) -> DataFrame:
    return _weighted(df).select("product_category").distinct()


def category_counts(df: DataFrame | Counted) -> DataFrame:
    """Reviews per category, fewest first."""
    counts = _weighted(df).groupBy("product_category").agg(F.sum(N).alias(N))
    return counts.orderBy(N, "product_category")


def total_count(df: DataFrame | Counted) -> DataFrame:
    return _weighted(df).agg(F.coalesce(F.sum(N), F.lit(0)).alias(N))


def category_mean(df: DataFrame | Counted) -> DataFrame:
    """Mean rating per category, lowest first."""
    means = _weighted(df).groupBy("product_category").agg(_mean_rating().alias("mean_rating"))
    return means.orderBy("mean_rating", "product_category")


def rating_histogram(df: DataFrame | Counted) -> DataFrame:
    """Reviews per category and rating; a rating a category lacks has no row."""
    rated = _weighted(df).where(is_rating(F.col("star_rating")))
    return rated.groupBy("product_category", "star_rating").agg(F.sum(N).alias(N))


def _star_counts() -> list[Column]:
    return [F.sum(F.when(F.col("star_rating") == s, F.col(N)).otherwise(0)).alias(f"n_{s}") for s in STARS]


def rating_histogram_wide(df: DataFrame | Counted) -> DataFrame:
    """Per category one count for each rating, zero where there is none."""
    return _weighted(df).groupBy("product_category").agg(*_star_counts())


def histogram_mean(histogram: DataFrame) -> DataFrame:
    """Mean rating per category from the rows of `rating_histogram`."""
    return histogram.groupBy("product_category").agg(_mean_rating().alias("mean_rating"))


def category_summary(df: DataFrame | Counted) -> DataFrame:
    """Count, means and rating distribution of each category, from one pass over the reviews."""
    return (
        _weighted(df)
        .groupBy("product_category")
        .agg(F.sum(N).alias(N), *_mean_by_purchase(), *_star_counts())
        .orderBy(N, "product_category")
    )


def _mean_by_purchase() -> list[Column]:
    return [
        _mean_rating().alias("mean_all"),
        _mean_rating(_is("verified_purchase", "Y")).alias("mean_verified"),
        _mean_rating(_is("verified_purchase", "N")).alias("mean_unverified"),
    ]


def verified_means(df: DataFrame | Counted) -> DataFrame:
    """Mean rating per category of all, of verified and of unverified purchases."""
    return _weighted(df).groupBy("product_category").agg(*_mean_by_purchase())


def verified_gap(means: DataFrame) -> DataFrame:
    """Distance between the verified and the unverified mean, from the rows of `verified_means`."""
    gap = F.abs(F.col("mean_verified") - F.col("mean_unverified"))
    return means.select("product_category", gap.alias("gap"))


def verified_gap_overall(gaps: DataFrame) -> DataFrame:
    """Mean of the gaps, each category counting once."""
    return gaps.agg(F.avg("gap").alias("mean_gap"))


def verified_margins(df: DataFrame | Counted) -> DataFrame:
    """Counts and means per category and purchase kind, with both margins and the total.

    The reviews are aggregated to the finest grain first: grouping sets copy each input row once
    per set.
    """
    keys = ["product_category", "verified_purchase"]
    weighted = _weighted(df).withColumn("n_rated", F.when(F.col("star_rating").isNotNull(), F.col(N)))
    finest = weighted.groupBy(*keys).agg(
        F.sum(N).alias(N),
        F.sum(F.col("star_rating") * F.col(N)).alias("stars"),
        F.sum("n_rated").alias("n_rated"),
    )
    category, verified = (F.col(k) for k in keys)
    return finest.groupingSets([[category, verified], [category], [verified], []], category, verified).agg(
        F.grouping("product_category").cast("int").alias("all_categories"),
        F.grouping("verified_purchase").cast("int").alias("all_purchases"),
        F.sum(N).alias(N),
        (F.sum("stars") / F.sum("n_rated")).alias("mean_rating"),
    )


def _known_purchases(df: DataFrame | Counted) -> DataFrame:
    return _weighted(df).where(F.col("verified_purchase").isin("Y", "N"))


def verified_rating_counts(df: DataFrame | Counted) -> DataFrame:
    """Reviews of verified and of unverified purchases, in all and by rating."""
    return _known_purchases(df).groupBy("verified_purchase").agg(F.sum(N).alias(N), *_star_counts())


def verified_rating_share(df: DataFrame | Counted) -> DataFrame:
    """The ten slices purchase kind by rating, each with its share in percent of all ten.

    The window without keys runs over the ten aggregated rows, never over reviews.
    """
    rated = _known_purchases(df).where(is_rating(F.col("star_rating")))
    slices = rated.groupBy("verified_purchase", "star_rating").agg(F.sum(N).alias(N))
    share = F.lit(100.0) * F.col(N) / F.sum(N).over(Window.partitionBy())
    return slices.withColumn("share_pct", F.round(share.cast("double"), 1))


def helpfulness_ratio(df: DataFrame | Counted) -> DataFrame:
    """Helpful votes as a share of all votes, per rating."""
    rated = _weighted(df).where(is_rating(F.col("star_rating")))
    sums = rated.groupBy("star_rating").agg(
        F.sum("helpful_votes").alias("helpful_votes"), F.sum("total_votes").alias("total_votes")
    )
    ratio = F.try_divide(F.col("helpful_votes"), F.col("total_votes"))
    return sums.withColumn("helpful_ratio", ratio).orderBy("star_rating")


def helpfulness_mean_ratio(df: DataFrame | Counted) -> DataFrame:
    """Mean over reviews with votes of their own share of helpful votes, per rating."""
    voted = _with_shares(df).where(is_rating(F.col("star_rating"))).where(F.col(N_VOTED) > 0)
    mean = F.sum(HELPFUL_SHARE) / F.sum(N_VOTED)
    return voted.groupBy("star_rating").agg(mean.alias("mean_helpful_ratio")).orderBy("star_rating")


def vine_contrast(df: DataFrame | Counted) -> DataFrame:
    """Mean rating of vine and of other reviews, and their distance."""
    means = _weighted(df).agg(
        _mean_rating(_is("vine", "Y")).alias("mean_vine"), _mean_rating(_is("vine", "N")).alias("mean_other")
    )
    return means.withColumn("difference", F.abs(F.col("mean_vine") - F.col("mean_other")))


def purchases(reviews: DataFrame, verified: str) -> DataFrame:
    """Customer, rating and purchase kind of the verified ('Y') or unverified ('N') reviews."""
    columns = reviews.select("customer_id", "star_rating", "verified_purchase")
    return columns.where(_is("verified_purchase", verified))


def top_helpful(reviews: DataFrame, n: int = 20) -> DataFrame:
    """The n reviews with the most helpful votes; each task keeps n rows of its own."""
    columns = reviews.select("customer_id", "helpful_votes", "verified_purchase")
    return columns.orderBy(F.desc_nulls_last("helpful_votes"), "customer_id", "verified_purchase").limit(n)
