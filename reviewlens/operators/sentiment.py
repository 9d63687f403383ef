"""Rating prediction: a word weighs the mean rating of the reviews it occurs in, and a review is
predicted the mean weight of its words."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.text import count_words, explode_words, words
from reviewlens.operators.frequent import heavy_words
from reviewlens.operators.words import N, telling_words
from reviewlens.schema import Counted, is_rating
from reviewlens.sources.files import store, store_bucketed

WEIGHT = "avg_rating"

# Longest word, in characters, that may be broadcast as one of many frequent words.
LONGEST_FREQUENT_WORD = 64

# Rows of a word above which it should not be one task's.
HOT_ROWS = 1_000_000

# Copies of a review that one row stands for at most.
COPIES = 1 << 16

# What a broadcast takes for a word beside its bytes, which it holds twice, as key and in the row.
WORD_BYTES = 130


def word_weights(
    reviews: DataFrame | Counted,
    text: str = "review_body",
    filter_words: bool = False,
    stop_words: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """Each word of the rated reviews with its mean rating and its number of occurrences.

    Takes reviews, or `Counted` words per rating, as `word_counts` returns them. A word used
    twice in a review counts twice. All words are kept unless `filter_words` asks for those that
    `top_words` would report.
    """
    if isinstance(reviews, Counted):
        counts = reviews.rows
    else:
        rated = reviews.where(is_rating(F.col("star_rating"))).select("star_rating", text)
        counts = explode_words(rated, text).withColumn(N, F.lit(1).cast("bigint"))
    mean = F.sum(F.col("star_rating") * F.col(N)) / F.sum(N)
    weights = counts.groupBy("word").agg(mean.alias(WEIGHT), F.sum(N).alias(N))
    return telling_words(weights, stop_words) if filter_words else weights


def word_total(reviews: DataFrame | Counted, text: str = "review_body") -> DataFrame:
    """Number of word occurrences in the rated reviews, counted within each row, or in the counts
    of their words."""
    if isinstance(reviews, Counted):
        reviews, n = reviews.rows, F.col(N)
    else:
        reviews, n = reviews.where(is_rating(F.col("star_rating"))), count_words(F.col(text))
    return reviews.agg(F.coalesce(F.sum(n), F.lit(0)).alias(N))


@dataclass(frozen=True)
class Vocabulary:
    """Word weights made for lookups: their table, bucketed and sorted by word, and its size."""

    table: DataFrame
    n_words: int
    word_bytes: int
    occurrences: int

    @property
    def broadcast_bytes(self) -> int:
        return broadcast_bytes(self.n_words, self.word_bytes)


def store_vocabulary(weights: DataFrame, buckets: int | None = None) -> Vocabulary:
    """`weights` written once as a table of `buckets` by word (by default as many as shuffles have
    partitions), in which scoring finds words without moving the table. `files.release` removes it."""
    return _sized(store_bucketed(weights.select("word", WEIGHT, N), "vocabulary", "word", buckets))


def _sized(lookup: DataFrame) -> Vocabulary:
    size = lookup.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("word_bytes"),
        F.coalesce(F.sum(N), F.lit(0)).alias("occurrences"),
    ).first()
    return Vocabulary(lookup, size["rows"], size["word_bytes"], size["occurrences"])


def predict_ratings(
    reviews: DataFrame,
    weights: DataFrame | Vocabulary,
    key: str = "review_id",
    text: str = "review_body",
    max_broadcast_bytes: int = 64 << 20,
    max_frequent_bytes: int = 32 << 20,
) -> DataFrame:
    """The predicted rating of each review, null where none of its words has a weight: one row for each
    row of `reviews`, whether its `key` is repeated, shared by other texts or null.

    `weights` is a `Vocabulary`, or a stored table of weights, as it is read more than once. Its size
    decides the plan, not the result: a vocabulary within `max_broadcast_bytes` is broadcast whole and the
    words of a review meet in the task that read it; see `_score_by_parts` for a larger one.
    """
    known = weights if isinstance(weights, Vocabulary) else _sized(weights.select("word", WEIGHT, N))

    # Equal texts under one key are scored together and given back as often as they came. Texts are hashed
    # and split below the explode, once, and go no further themselves.
    body = F.col(text)
    same_text = (F.xxhash64(body).alias("text_1"), F.xxhash64(F.lit(text), body).alias("text_2"))
    split = reviews.select(F.col(key), *same_text, words(body).alias("words"))
    found = split.select(key, *TEXT, F.posexplode_outer("words").alias("at", "word"))
    first = (F.coalesce("at", F.lit(0)) == 0).cast("bigint")
    found = found.select(key, *TEXT, first.alias("first"), F.nullif("word", F.lit("")).alias("word"))
    if known.broadcast_bytes <= max_broadcast_bytes:
        scored = found.join(F.broadcast(known.table.select("word", WEIGHT)), "word", "left")
        return _mean(scored, key, F.sum(WEIGHT), F.count(WEIGHT))

    # Fewer than n words can each make up more than 1/n of all occurrences: the bound on what is
    # broadcast holds for any vocabulary.
    n = max(1, max_frequent_bytes // broadcast_bytes(1, 4 * LONGEST_FREQUENT_WORD))
    return _score_by_parts(found, known, key, n, max_frequent_bytes)


# What tells apart the texts that share a key.
TEXT = ("text_1", "text_2")


def broadcast_bytes(n_words: int, word_bytes: int) -> int:
    """What a broadcast vocabulary takes in each executor."""
    return WORD_BYTES * n_words + 2 * word_bytes


def _mean(scored: DataFrame, key: str, total: Column, hits: Column) -> DataFrame:
    """One row for each review of a text. A text that came very often is first made into rows of at most
    COPIES reviews each, so that no array is longer."""
    per_text = scored.groupBy(key, *TEXT).agg(F.try_divide(total, hits).alias("predicted_rating"), F.sum("first").alias("times"))
    some = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1, F.lit(COPIES).cast("bigint"))).alias("before")
    parts = per_text.select(key, "predicted_rating", "times", some)
    copies = F.least(F.col("times") - F.col("before"), F.lit(COPIES)).cast("int")
    return parts.select(key, "predicted_rating", F.explode(F.array_repeat(F.lit(True), copies))).select(key, "predicted_rating")


def _score_by_parts(found: DataFrame, known: Vocabulary, key: str, n: int, max_frequent_bytes: int) -> DataFrame:
    """Scores with a broadcast of the frequent words and a shuffle of the others.

    Frequent words, fewer than n of the training texts, are most of any text; they are added up in the task
    that read the review, one row per review. Words that are rare in training and yet HOT_ROWS and more
    than 1/n of what is left of the scored texts would be one task's of the shuffle: they are measured, and
    broadcast with their weight, if they have one. The other words go to an inner join with the weights, which stay
    where they are if they are bucketed by word; words unseen in training end there. A last sum by review
    takes both.
    """
    usual = (F.col(N) > known.occurrences // n) & (F.length("word") <= LONGEST_FREQUENT_WORD)
    frequent = known.table.where(usual)
    others = found.where(F.col("word").isNotNull()).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    hot = store(heavy_words(others.select("word"), n, HOT_ROWS).select("word"), "hot-words")
    size = hot.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if broadcast_bytes(*size) > max_frequent_bytes:
        hot = hot.where(F.length("word") <= LONGEST_FREQUENT_WORD)
    if size[0]:
        others = others.join(F.broadcast(hot), "word", "left_anti")
        weighed = known.table.where(~usual).join(F.broadcast(hot), "word", "left_semi")
        frequent = store(frequent.unionByName(weighed), "frequent-words")
    scored = found.join(F.broadcast(frequent.select("word", WEIGHT)), "word", "left")
    scored = scored.groupBy(key, *TEXT).agg(F.sum(WEIGHT).alias("total"), F.count(WEIGHT).alias("hits"), F.sum("first").alias("first"))
    # A hint, as Spark might broadcast the weights by its own estimate of their size.
    hit = others.join(known.table.select("word", WEIGHT).hint("merge"), "word")
    hit = hit.select(key, *TEXT, F.col(WEIGHT).alias("total"), F.lit(1).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("first"))
    return _mean(scored.unionByName(hit), key, F.sum("total"), F.sum("hits"))
