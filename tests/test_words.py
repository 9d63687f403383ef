import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import words
from reviewlens.schema import DEFAULT_HEADLINES

COLUMNS = "product_category string, star_rating int, review_headline string, review_body string"
STOP = ["the", "of"]


def random_rows(n=400, seed=5):
    """A third of the reviews in one category, and a third of all words the same one."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "10", "x1", "f***", "-dash"] + [f"w{i}" for i in range(40)]

    def text():
        return " ".join("hot" if rng.random() < 0.33 else rng.choice(vocabulary) for _ in range(rng.randrange(30)))

    rows = []
    for i in range(n):
        category = "Hot" if i % 3 == 0 else rng.choice(["A", "B"])
        headline = rng.choice([None, "five stars", *DEFAULT_HEADLINES, text(), text(), text()])
        rows.append((category, rng.choice([1, 2, 3, 4, 5, None]), headline, text() if rng.random() < 0.95 else None))
    return rows


def counts_of(rows, column, stop=STOP, numbers=True):
    counts = {}
    for row in rows:
        if row[1] is None or row[column] is None:
            continue
        for word in row[column].lower().split():
            kept = word not in stop and word not in ("a", "f***", "-dash") and (numbers or word != "10")
            if kept:
                counts.setdefault((row[0], row[1]), Counter())[word] += 1
    return counts


def best(counts, k):
    return {
        (*group, rank, word, n)
        for group, words_of in counts.items()
        for rank, (word, n) in enumerate(sorted(words_of.items(), key=lambda w: (-w[1], w[0]))[:k], 1)
    }


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_top_words(reviews, k):
    table = reviews(random_rows(), COLUMNS)
    assert found(words.top_words(table, k, stop_words=STOP)) == best(counts_of(random_rows(), 3), k)


def test_stop_words_as_table(spark, reviews):
    stop = spark.createDataFrame([(w,) for w in STOP], "w string")
    table = reviews(random_rows(), COLUMNS)
    assert found(words.top_words(table, stop_words=stop)) == best(counts_of(random_rows(), 3), 10)


def test_stop_words_as_large_table(spark, reviews):
    stop = spark.createDataFrame([(w,) for w in STOP], "w string").hint("merge")
    table = reviews(random_rows(), COLUMNS)
    assert found(words.top_words(table, stop_words=stop)) == best(counts_of(random_rows(), 3), 10)


def test_numbers_are_kept_unless_dropped(reviews):
    table = reviews(random_rows(), COLUMNS)
    assert "10" in {r["word"] for r in words.top_words(table, 50).collect()}
    dropped = words.top_words(table, 50, stop_words=STOP, drop_numbers=True)
    assert found(dropped) == best(counts_of(random_rows(), 3, numbers=False), 50)


def overall(counts):
    total = {}
    for (_, star), words_of in counts.items():
        total.setdefault((star,), Counter()).update(words_of)
    return total


def test_top_words_overall(reviews):
    table = reviews(random_rows(), COLUMNS)
    expected = best(overall(counts_of(random_rows(), 3)), 10)
    assert found(words.top_words_overall(table, stop_words=STOP)) == expected
    counts = words.over_all_categories(words.telling_words(words.word_counts(table), STOP))
    assert found(words.rank_words(counts, 10, ["star_rating"])) == expected


def test_top_headline_words(reviews):
    rows = [(*r[:2], None if r[2] in DEFAULT_HEADLINES else r[2], r[3]) for r in random_rows()]
    table = reviews(random_rows(), COLUMNS)
    assert found(words.top_headline_words(table, stop_words=STOP)) == best(counts_of(rows, 2), 3)


def test_default_headlines_are_compared_as_written(reviews):
    titles = ["Five Stars", "five stars", "Five Stars!", " One Star", "One Star", None]
    table = reviews([("A", 5, t, None) for t in titles], COLUMNS)
    left = [r["review_headline"] for r in words.without_default_headlines(table).collect()]
    assert left == ["five stars", "Five Stars!", " One Star", None]


def test_word_lists(reviews):
    lists = words.top_word_lists(reviews(random_rows(), COLUMNS), 4, stop_words=STOP).collect()
    counts = counts_of(random_rows(), 3)
    counts.update({("Overall", *star): words_of for star, words_of in overall(counts).items()})
    expected = {}
    for category, star, rank, word, _ in sorted(best(counts, 4), key=lambda r: r[2]):
        expected.setdefault((category, star), []).append(word)
    assert {(r["product_category"], r["star_rating"]): r["words"] for r in lists} == expected


def test_equal_counts_are_in_word_order(reviews):
    table = reviews([("A", 1, None, "bb aa cc bb aa cc")], COLUMNS)
    assert [r["word"] for r in words.top_words(table, 2).orderBy("rank").collect()] == ["aa", "bb"]


def test_reported_words_are_telling(reviews):
    texts = "The f*** f**k - a 4-7 rinse\" , don't !!! x *** (no)"
    table = reviews([("A", 1, None, texts)], COLUMNS)
    assert {r["word"] for r in words.top_words(table).collect()} == {"the", "f**k", "4-7", 'rinse"', "dont"}


def test_ratings_outside_one_to_five_are_left_out(reviews):
    table = reviews([("A", s, None, "word") for s in (0, 1, 5, 6, None)], COLUMNS)
    assert {r["star_rating"] for r in words.word_counts(table).collect()} == {1, 5}
    assert words.word_counts(table).agg(F.sum("n_words")).first()[0] == 2
