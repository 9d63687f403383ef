"""Most used words of headlines and bodies.

Word filters depend on the word alone, so they are written on the counts: Spark moves them ahead of
the count where it is part of the same plan, and a stored count serves reports of any filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.text import explode_words, is_telling, without_stop_words
from reviewlens.schema import DEFAULT_HEADLINES, STARS, is_rating

STAR = "star_rating"
BY = ("product_category", STAR)
N = "n_words"


def rated_texts(reviews: DataFrame, text: str = "review_body", by: Sequence[str] = BY) -> DataFrame:
    """The texts of rated reviews and their group."""
    return reviews.where(is_rating(F.col(STAR))).select(*by, text)


def count_by_rating(rows: DataFrame, by: Sequence[str], *keys: str | Column) -> DataFrame:
    """How many of `rows`, all rated, there are for each combination of `by` and `keys`.

    The ratings of a key are counted beside each other, so a task ships a row for a key and not one for
    each of its ratings; they are set below each other once counted.
    """
    others = [c for c in by if c != STAR]
    if len(others) == len(by):
        return rows.groupBy(*by, *keys).agg(F.count("*").alias(N))
    counters = [F.count_if(F.col(STAR) == star).alias(f"__n_{star}") for star in STARS]
    wide = rows.groupBy(*others, *keys).agg(*counters)
    beside = [F.struct(F.lit(star).alias(STAR), F.col(f"__n_{star}").alias(N)) for star in STARS]
    # Ratings that do not occur are left out here and not by a filter above, which would keep a stop list
    # that is joined to the counts from moving ahead of them.
    below = F.inline(F.filter(F.array(*beside), lambda counted: counted[N] > 0))
    named = [c for c in wide.columns if not c.startswith("__n_")]
    return wide.select(*named, below).select(*by, *[c for c in named if c not in by], N)


def word_counts(reviews: DataFrame, text: str = "review_body", by: Sequence[str] = BY) -> DataFrame:
    """How often each word occurs in the texts of each group of rated reviews.

    Words are counted in the map task first, so a word of every review reaches the shuffle once per
    task and category, whatever its ratings.
    """
    return count_by_rating(explode_words(rated_texts(reviews, text, by), text), by, "word")


def telling_words(
    counts: DataFrame, stop_words: Iterable[str] | DataFrame | None = None, drop_numbers: bool = False
) -> DataFrame:
    """The counts of words worth reporting.

    A listed or broadcast stop list takes effect before the count; a larger one is joined after it,
    when a word occurs once per group.
    """
    return without_stop_words(counts.where(is_telling(F.col("word"), drop_numbers)), stop_words)


def without_default_headlines(reviews: DataFrame, titles: Sequence[str] = DEFAULT_HEADLINES) -> DataFrame:
    """Reviews whose headline is the customer's own, compared as written. Keeps null headlines."""
    headline = F.col("review_headline")
    return reviews.where(headline.isNull() | ~headline.isin(*titles))


def headline_word_counts(reviews: DataFrame, titles: Sequence[str] = DEFAULT_HEADLINES) -> DataFrame:
    """`word_counts` of headlines, default headlines apart."""
    return word_counts(without_default_headlines(reviews, titles), "review_headline")


def over_all_categories(counts: DataFrame) -> DataFrame:
    """Word counts per rating from those per category and rating."""
    return counts.groupBy("star_rating", "word").agg(F.sum(N).alias(N))


def rank_words(counts: DataFrame, k: int, by: Sequence[str] = BY) -> DataFrame:
    """The k most frequent words of each group, ties in word order.

    Spark keeps k rows per group and task before the shuffle, for any k up to a limit of its own;
    beyond that limit a first ranking of hashed parts of each group does the same.
    """
    order = [F.desc(N), F.col("word")]
    if k > int(counts.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.xxhash64("word"), F.lit(256))
        within = Window.partitionBy(*by, part).orderBy(*order)
        counts = counts.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("rank")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(*by, "rank", "word", N)


def top_words(reviews: DataFrame, k: int = 10, **filters) -> DataFrame:
    """The k most used body words per category and rating."""
    return rank_words(telling_words(word_counts(reviews), **filters), k)


def top_words_overall(reviews: DataFrame, k: int = 10, **filters) -> DataFrame:
    """The k most used body words per rating, counted without regard to category."""
    by = ["star_rating"]
    return rank_words(telling_words(word_counts(reviews, by=by), **filters), k, by)


def top_headline_words(reviews: DataFrame, k: int = 3, **filters) -> DataFrame:
    """The k most used headline words per category and rating."""
    return rank_words(telling_words(headline_word_counts(reviews), **filters), k)


def rank_words_with_overall(counts: DataFrame, k: int, overall: str = "Overall") -> DataFrame:
    """`rank_words` of each category and rating, and of each rating under the category `overall`.

    Both rankings start from the same shuffle of counts, which Spark runs once.
    """
    total = over_all_categories(counts).withColumn("product_category", F.lit(overall))
    return rank_words(counts, k).unionByName(rank_words(total, k))


def word_lists(ranked: DataFrame) -> DataFrame:
    """One row per category and rating, its words in rank order as an array.

    At most k words each, k being that of the ranking.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(*BY).agg(ordered["word"].alias("words"))


def top_word_lists(reviews: DataFrame, k: int = 10, **filters) -> DataFrame:
    """Word lists of each category and rating, and of each rating overall, from one word count."""
    return word_lists(rank_words_with_overall(telling_words(word_counts(reviews), **filters), k))
