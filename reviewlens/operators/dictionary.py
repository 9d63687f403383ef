"""Reviews as numbers: every word of the texts by its place in a dictionary.

Texts are cleaned, split and looked up once; counts, weights and scores then shuffle and broadcast numbers,
and words are spelt again in what is reported. Identifiers are given by frequency, so that the words most
rows hold have small ones, which Parquet stores in few bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.text import words
from reviewlens.operators.frequent import ROW_BYTES
from reviewlens.operators.sentiment import LONGEST_FREQUENT_WORD, WEIGHT, WORD_BYTES, broadcast_bytes
from reviewlens.operators.words import BY, N, STAR, count_by_rating, telling_words
from reviewlens.schema import is_rating
from reviewlens.sources.files import MAX_BROADCAST_BYTES, small, store

ID = "word_id"

# The row of a review among those coded together.
ROW = "row_id"

# Parts that words of one frequency are numbered in.
PARTS = 256

# What a weight by number takes in a broadcast.
ID_BYTES = 32


def word_dictionary(counts: DataFrame) -> DataFrame:
    """word, word_id and n_words of every word in `counts` (see `word_counts`): 0, 1, 2 and so on, the
    most frequent word first.

    Words are counted per (frequency, part), a part being a hash of the word; running sums over those
    counts give each part its first number, and a window within a part the rest. No task holds more than a
    part, or one row per distinct frequency: fewer than the root of twice the number of occurrences, as
    different frequencies add up to that at least.
    """
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")
    listed = store(counts.groupBy("word").agg(F.sum(N).alias(N)).select("word", N, part), "vocabulary")
    cells = store(listed.groupBy(N, "part").agg(F.count("*").alias("size")), "cells")
    running = (Window.unboundedPreceding, -1)
    before = F.sum("size").over(Window.orderBy(F.desc(N)).rowsBetween(*running))
    per_n = cells.groupBy(N).agg(F.sum("size").alias("size")).select(N, F.coalesce(before, F.lit(0)).alias("n_before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy(N).orderBy("part").rowsBetween(*running)), F.lit(0))
    firsts = cells.select(N, "part", within.alias("part_before")).join(per_n, N)
    firsts = firsts.select(N, "part", (F.col("n_before") + F.col("part_before")).alias("first"))
    own = F.row_number().over(Window.partitionBy(N, "part").orderBy("word")) - 1
    numbered = listed.withColumn("own", own).join(firsts, [N, "part"])
    return numbered.select("word", (F.col("first") + F.col("own")).alias(ID), N)


def code_reviews(
    reviews: DataFrame,
    dictionary: DataFrame,
    text: str = "review_body",
    others: Sequence[str] = ("review_id", *BY),
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """row_id, `others` and word_id for every word of every review; a review without known words has one
    row of no word. It is stored, as `row_id` is given as it is computed.

    A stored dictionary within `max_broadcast_bytes` is broadcast, and nothing is shuffled. Of a larger one
    the most frequent words are broadcast, which are most of any text. What they leave is joined by a shuffle,
    the only one that moves words; adaptive execution splits a word that makes up much of it.
    """
    rows = reviews.select(F.monotonically_increasing_id().alias(ROW), *others, words(F.col(text)).alias("words"))
    found = rows.select(ROW, *others, F.posexplode_outer("words").alias("at", "word"))
    # The first word stands for the review if it is unknown; other unknown words go.
    first = F.coalesce("at", F.lit(0)) == 0
    columns = [ROW, *others, ID]
    usual = _broadcast_words(dictionary, max_broadcast_bytes)
    lookup = dictionary.select("word", ID)
    if usual is None:
        coded = found.join(F.broadcast(lookup), "word", "left")
        return store(coded.where(first | F.col(ID).isNotNull()).select(columns), "coded")
    # Numbered by then: the place a row is read at must not change between the parts of the join.
    met = found.join(F.broadcast(lookup.where(usual)), "word", "left")
    missed = F.when(F.col(ID).isNull(), F.nullif("word", F.lit("")))
    met = met.select(*columns, first.alias("__first"), missed.alias("word"))
    met = store(met.where(F.col("__first") | F.col("word").isNotNull() | F.col(ID).isNotNull()), "words")
    rare = met.where(F.col("word").isNotNull()).drop(ID).join(lookup.where(~usual).hint("merge"), "word", "left")
    rare = store(rare.where(F.col("__first") | F.col(ID).isNotNull()).select(columns), "rare-words")
    return met.where(F.col("word").isNull()).select(columns).unionByName(rare)


def _broadcast_words(dictionary: DataFrame, max_bytes: int) -> Column | None:
    """Which words of a dictionary are broadcast if not all of them are within `max_bytes`: as many of the
    most frequent ones as are, by halves of what it would take without their letters."""
    most = max(0, max_bytes) // WORD_BYTES
    # The last is within the bound for any words, as none is longer.
    usual = [(F.col(ID) < (most >> half)) & (F.length("word") <= LONGEST_FREQUENT_WORD) for half in range(4)]
    sizes = [F.struct(F.count_if(u), F.coalesce(F.sum(F.when(u, F.octet_length("word"))), F.lit(0))) for u in (F.lit(True), *usual)]
    whole, *parts = dictionary.agg(*sizes).first()
    if broadcast_bytes(*whole) <= max_bytes:
        return None
    return next((u for u, size in zip(usual, parts) if broadcast_bytes(*size) <= max_bytes), usual[-1])


def _known(coded: DataFrame) -> DataFrame:
    return coded.where(F.col(ID).isNotNull() & is_rating(F.col(STAR)))


def coded_word_counts(coded: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """`word_counts` by number."""
    return count_by_rating(_known(coded), by, ID)


def coded_weights(coded: DataFrame) -> DataFrame:
    """`word_weights` by number."""
    stars = F.sum(F.col(STAR).cast("bigint")) / F.count("*")
    return _known(coded).groupBy(ID).agg(stars.alias(WEIGHT), F.count("*").alias(N))


def spelt(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`rows` with the word in place of its number."""
    named = rows.join(dictionary.select(ID, "word"), ID)
    return named.select(*["word" if c == ID else c for c in rows.columns])


def _join_by_number(rows: DataFrame, lookup: DataFrame, how: str, max_broadcast_bytes: int) -> DataFrame:
    """`rows` joined with `lookup`, which is stored and has a number once; `how` is left or left_semi.

    A lookup within `max_broadcast_bytes` is broadcast. Of a larger one the smallest numbers are, those of the
    most frequent words; only rows of others are shuffled.
    """
    most = max(0, max_broadcast_bytes) // ID_BYTES
    if lookup.count() <= most:
        return rows.join(F.broadcast(lookup), ID, how)
    usual = F.col(ID) < most
    rare = rows.where(~usual).join(lookup.where(~usual).hint("merge"), ID, how)
    others = rows.where(F.col(ID).isNull() | usual)
    return others.join(F.broadcast(lookup.where(usual)), ID, how).unionByName(rare)


def coded_top_words(
    counts: DataFrame,
    dictionary: DataFrame,
    k: int = 10,
    by: Sequence[str] = BY,
    stop_words: Iterable[str] | DataFrame | None = None,
    drop_numbers: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """`rank_words` of `telling_words`, from counts by number.

    The dictionary is filtered instead of the counts, and only the words of the k highest counts, ties
    among them, are spelt: the words of a tie decide who is in.
    """
    telling = store(telling_words(dictionary.select("word", ID), stop_words, drop_numbers), "telling")
    kept = _join_by_number(counts, telling.select(ID), "left_semi", max_broadcast_bytes)
    high = kept.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(N)))).where(F.col("rank") <= k)
    named = telling.join(small(store(high.drop("rank"), "high"), ROW_BYTES), ID)
    order = Window.partitionBy(*by).orderBy(F.desc(N), "word")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "rank", "word", N)


def coded_predictions(
    coded: DataFrame, weights: DataFrame, key: str = "review_id", max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """`predict_ratings` by number: `key` and predicted_rating of every coded review.

    `weights` is a stored table; within `max_broadcast_bytes` it is broadcast, as numbers. Of a larger one the
    smallest numbers are, those of the most frequent words; only what they leave is shuffled by number.
    """
    scored = _join_by_number(coded.select(ROW, key, ID), weights.select(ID, WEIGHT), "left", max_broadcast_bytes)
    mean = F.try_divide(F.sum(WEIGHT), F.count(WEIGHT)).alias("predicted_rating")
    return scored.groupBy(ROW, key).agg(mean).select(key, "predicted_rating")
