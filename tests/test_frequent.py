"""The most frequent words by buckets, against counting them all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.text import explode_words
from reviewlens.operators import frequent, words
from reviewlens.sources import files
from tests.test_plans import shuffled_rows
from tests.test_words import COLUMNS, STOP, found, random_rows


@pytest.mark.parametrize("k, buckets", [(1, 3), (3, 50), (10, 1), (10, 2048), (100, 50)])
def test_same_rows_as_counting_all(reviews, k, buckets):
    table = reviews([*random_rows(), *[(None, s, None, "no category 10 10") for s in range(1, 6)]], COLUMNS)
    expected = found(words.top_words(table, k, stop_words=STOP, drop_numbers=True))
    assert found(frequent.top_words(table, k, buckets=buckets, stop_words=STOP, drop_numbers=True)) == expected


@pytest.mark.parametrize("limit", [files.MAX_BROADCAST_BYTES, -1])
def test_overall_ties_and_large_lists(reviews, monkeypatch, limit):
    """Every word as often as every other: all buckets reach the floor."""
    monkeypatch.setattr(files, "MAX_BROADCAST_BYTES", limit)
    rows = [("A", 1 + i % 2, None, " ".join(f"w{j}" for j in range(60))) for i in range(4)]
    table = reviews(rows, COLUMNS)
    expected = found(words.top_words_overall(table, 5))
    assert found(frequent.top_words(table, 5, by=["star_rating"], buckets=400)) == expected
    assert {r[2] for r in expected} == {"w0", "w1", "w10", "w11", "w12"}


def test_no_words(reviews):
    assert frequent.top_words(reviews([("A", 1, None, None), ("A", None, None, "x y")], COLUMNS)).collect() == []


def test_a_tenth_of_the_rows_is_shuffled(spark, reviews):
    """90,000 different words in each of two groups, a few of them frequent."""
    r = random.Random(4)
    rows = []
    for i in range(300):
        text = " ".join([f"rare{i}x{j}" for j in range(600)] + [f"often{int(r.paretovariate(1))}" for _ in range(400)])
        rows.append(("A", 1 + i % 2, None, text))
    table = files.store(reviews(rows, COLUMNS), "many-words")
    every = words.top_words(table, 5)
    n_every = shuffled_rows(every)
    expected = found(every)
    shuffled = []
    before = frequent.store, frequent._counts_in
    try:
        frequent.store = lambda df, name: (shuffled.append(shuffled_rows(df)), before[0](df, name))[1]
        result = frequent.top_words(table, 5, buckets=512)
        shuffled.append(shuffled_rows(result))
    finally:
        frequent.store = before[0]
    assert found(result) == expected
    assert 10 * sum(shuffled) < n_every


@pytest.mark.parametrize("n", [1, 4, 25, 1000])
def test_heavy_words(spark, n):
    r = random.Random(n)
    listed = [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)]
    rows = spark.createDataFrame([(" ".join(listed[i : i + 30]),) for i in range(0, 3000, 30)], "t string")
    expected = {(w, c) for w, c in Counter(listed).items() if c > 3000 // n}
    for buckets in (frequent.BUCKETS, 1, 10_000):
        assert {tuple(x) for x in frequent.heavy_words(explode_words(rows, "t"), n, buckets=buckets).collect()} == expected
    few = {(w, c) for w, c in expected if c > 100}
    assert {tuple(x) for x in frequent.heavy_words(explode_words(rows, "t"), n, 100).collect()} == few
    assert frequent.heavy_words(explode_words(rows, "t").where(F.lit(False)), n).collect() == []
