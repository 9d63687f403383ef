"""The most frequent words, exactly, without shuffling the vocabulary.

Words fall into buckets by a hash, and a first pass counts buckets: as many rows as there are buckets, however
many words there are. A bucket's count bounds that of each of its words from above, so a bucket that is
small enough holds no word that could matter, and only the words of the others are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.text import explode_words
from reviewlens.operators.words import BY, N, count_by_rating, rank_words, rated_texts, telling_words
from reviewlens.sources.files import small, store

# Buckets that the words of a group are counted in, and those counted first, as a multiple of k.
BUCKETS = 2048
FIRST = 4

# What a row of a group and a bucket takes in a broadcast.
ROW_BYTES = 200


def bucket_of(word: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _counts_in(words: DataFrame, chosen: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """The counts of all words of the chosen buckets, given as `by` and bucket."""
    asked = small(chosen.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("bucket").alias("__bucket")), ROW_BYTES)
    same = F.col("__bucket") == bucket_of("word", buckets)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return words.join(asked, same).groupBy(*by, "word").agg(F.count("*").alias(N))


def top_words(
    reviews: DataFrame,
    k: int = 10,
    text: str = "review_body",
    by: Sequence[str] = BY,
    buckets: int = BUCKETS,
    stop_words: Iterable[str] | DataFrame | None = None,
    drop_numbers: bool = False,
) -> DataFrame:
    """The rows of `words.top_words`, for vocabularies too large to shuffle.

    Three passes over the texts at most. (1) Buckets are counted per group. (2) The words of each group's
    FIRST * k largest buckets are counted; the k-th largest of these counts, or 1 if there are fewer than k,
    is the floor. (3) If a group has more buckets that reach the floor, their words are counted too.

    That is exact. Every count ranked is that of a whole word, as a word lies in one bucket. k words at
    least have the floor or more, so the k-th count of the group is no less. A word left out lies in a bucket
    that counts less than the floor, and so does the word itself: k words have more occurrences than it has,
    and no tie with the k-th is lost. With fewer than k words counted the floor is 1, and nothing is left out.
    """
    rated = explode_words(rated_texts(reviews, text, by), text)
    words = telling_words(rated, stop_words, drop_numbers)
    totals = count_by_rating(words, by, bucket_of("word", buckets).alias("bucket"))
    order = Window.partitionBy(*by).orderBy(F.desc(N), "bucket")
    totals = store(totals.withColumn("place", F.row_number().over(order)), "buckets")
    found = store(_counts_in(words, totals.where(F.col("place") <= FIRST * k), by, buckets), "counts")
    floor = rank_words(found, k, by).where(F.col("rank") == k).select(*[F.col(c).alias(f"__{c}") for c in by], F.col(N).alias("floor"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    others = totals.where(F.col("place") > FIRST * k).join(floor, same, "left").where(F.col(N) >= F.coalesce("floor", F.lit(1)))
    others = store(others.select(*by, "bucket"), "more-buckets")
    if not others.isEmpty():
        found = found.unionByName(_counts_in(words, others, by, buckets))
    return rank_words(found, k, by)


def heavy_words(words: DataFrame, n: int, least: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Each `word` that makes up more than 1/n of the rows of `words`, and more than `least` rows, with its
    count: fewer than n.

    Only the words of buckets that themselves have as many rows are counted: a word with more occurrences
    lies in such a bucket.
    """
    totals = store(words.groupBy(bucket_of("word", buckets).alias("bucket")).agg(F.count("*").alias(N)), "buckets")
    least = max(least, totals.agg(F.coalesce(F.sum(N), F.lit(0))).first()[0] // n)
    chosen = totals.where(F.col(N) > least)
    if chosen.isEmpty():
        return words.select("word", F.lit(0).cast("bigint").alias(N)).limit(0)
    return _counts_in(words, chosen, (), buckets).where(F.col(N) > least)
