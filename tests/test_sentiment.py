import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import sentiment
from reviewlens.operators.words import word_counts
from reviewlens.schema import Counted
from reviewlens.sources.files import store

COLUMNS = "review_id string, star_rating int, review_body string"


def random_rows(n=300, seed=11):
    """A third of all words are the same one, and some words are in unrated reviews only."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        star = rng.choice([1, 2, 3, 4, 5, None])
        own = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(40))]
        text = ["hot" if rng.random() < 0.33 else w for w in own]
        rows.append((str(i), star, " ".join(text) if rng.random() < 0.95 else None))
    rows += [("unseen", None, "nothing known here"), ("empty", None, ""), ("null", None, None)]
    rows += [("common-unseen-%d" % i, None, "zzz zzz w1") for i in range(100)]
    return rows


def weights_of(rows):
    ratings = defaultdict(list)
    for _, star, text in rows:
        if star is not None and text is not None:
            for word in text.split():
                ratings[word].append(star)
    return {w: (sum(r) / len(r), len(r)) for w, r in ratings.items()}


def predictions_of(rows, weights):
    result = {}
    for key, _, text in rows:
        known = [weights[w][0] for w in (text or "").split() if w in weights]
        result[key] = sum(known) / len(known) if known else None
    return result


@pytest.fixture(params=["reviews", "counts"])
def either(request, reviews):
    """Reviews, or the counts of their words."""
    table = reviews(random_rows(), COLUMNS)
    return table if request.param == "reviews" else Counted(word_counts(table))


def test_word_weights(either):
    found = sentiment.word_weights(either).collect()
    assert {r["word"]: (r["avg_rating"], r["n_words"]) for r in found} == weights_of(random_rows())


def test_word_total(either):
    total = sum(n for _, n in weights_of(random_rows()).values())
    assert sentiment.word_total(either).first()["n_words"] == total


def test_no_words(reviews):
    assert sentiment.word_total(reviews([], COLUMNS)).first()["n_words"] == 0


def test_filtered_weights(reviews):
    table = reviews([("1", 5, "The good -x a 10"), ("2", 1, "the f***")], COLUMNS)
    found = sentiment.word_weights(table, filter_words=True, stop_words=["the"]).collect()
    assert {r["word"] for r in found} == {"good", "10"}
    unfiltered = sentiment.word_weights(table, stop_words=["the"]).collect()
    assert {r["word"] for r in unfiltered} == {"the", "good", "-x", "a", "10", "f***"}


# What a frequent word is charged.
FREQUENT = sentiment.broadcast_bytes(1, 4 * sentiment.LONGEST_FREQUENT_WORD)

# The whole vocabulary broadcast; its frequent words only; none of them; all of them by their number.
PLANS = [
    {},
    {"max_broadcast_bytes": 0, "max_frequent_bytes": 20 * FREQUENT},
    {"max_broadcast_bytes": 0, "max_frequent_bytes": FREQUENT},
    {"max_broadcast_bytes": 0, "max_frequent_bytes": 10**6 * FREQUENT},
]


@pytest.mark.parametrize("made_for_lookups", [False, True])
@pytest.mark.parametrize("options", PLANS)
def test_predictions(reviews, options, made_for_lookups):
    rows = random_rows()
    table = reviews(rows, COLUMNS)
    weights = sentiment.word_weights(table)
    weights = sentiment.store_vocabulary(weights) if made_for_lookups else store(weights, "weights")
    found = sentiment.predict_ratings(table, weights, **options).collect()
    expected = predictions_of(rows, weights_of(rows))
    assert len(found) == len(expected)
    for row in found:
        if expected[row["review_id"]] is None:
            assert row["predicted_rating"] is None
        else:
            assert row["predicted_rating"] == pytest.approx(expected[row["review_id"]], abs=1e-9)
            assert 1 <= row["predicted_rating"] <= 5


@pytest.mark.parametrize("limit", [5, 20, 100])
def test_few_words_are_frequent(reviews, limit):
    """Whatever the vocabulary, fewer words are broadcast than the limit says."""
    weights = sentiment.word_weights(reviews(random_rows(), COLUMNS))
    total = weights.agg(F.sum("n_words")).first()[0]
    assert weights.where(F.col("n_words") > total // limit).count() < limit


def test_long_words_are_not_broadcast(reviews):
    long_word = "x" * 1000
    rows = [("1", 5, f"{long_word} good"), ("2", 1, f"{long_word} bad"), ("3", None, long_word)]
    table = reviews(rows, COLUMNS)
    weights = store(sentiment.word_weights(table), "weights")
    scored = sentiment.predict_ratings(table, weights, max_broadcast_bytes=0)
    assert {r["review_id"]: r["predicted_rating"] for r in scored.collect()} == {"1": 4.0, "2": 2.0, "3": 3.0}


def test_words_rare_in_training_and_frequent_in_scored_texts(reviews, monkeypatch):
    """Some with a weight and some without, one of them too long to be one of many frequent words."""
    monkeypatch.setattr(sentiment, "HOT_ROWS", 10)
    trained = [(str(i), 1 + i % 5, " ".join(f"t{i % 40}" for _ in range(50))) for i in range(200)]
    trained += [("a", 5, "seldom"), ("b", 2, "seldom " + "y" * 200)]
    weights = sentiment.store_vocabulary(sentiment.word_weights(reviews(trained, COLUMNS)), buckets=3)
    rows = [(str(i), None, " ".join(["seldom", "unknown", "t1", "y" * 200][: 1 + i % 4]) + f" once{i}") for i in range(300)]
    expected = predictions_of(rows, weights_of(trained))
    for limit in (5 * FREQUENT, 300 * FREQUENT):
        scored = sentiment.predict_ratings(reviews(rows, COLUMNS), weights, max_broadcast_bytes=0, max_frequent_bytes=limit)
        assert {r["review_id"]: r["predicted_rating"] for r in scored.collect()} == pytest.approx(expected)


def test_very_many_equal_reviews(reviews, monkeypatch):
    monkeypatch.setattr(sentiment, "COPIES", 7)
    weights = store(sentiment.word_weights(reviews([("1", 4, "good")], COLUMNS)), "weights")
    for n in (6, 7, 8, 30):
        rows = [(None, None, "good")] * n + [("x", None, "other")]
        scored = sentiment.predict_ratings(reviews(rows, COLUMNS), weights)
        assert sorted(map(str, map(tuple, scored.collect()))) == sorted([str((None, 4.0))] * n + [str(("x", None))])


def test_no_vocabulary(reviews):
    table = reviews([("1", None, "good")], COLUMNS)
    weights = store(sentiment.word_weights(table), "weights")
    for options in ({}, {"max_broadcast_bytes": -1}):
        scored = sentiment.predict_ratings(table, weights, **options).collect()
        assert [tuple(r) for r in scored] == [("1", None)]


def test_example_texts(spark, reviews):
    """Texts are cleaned as the reviews were; unknown words are passed over."""
    trained = reviews([("1", 5, "Perfect. I love it!"), ("2", 1, "Terrible, I want a refund")], COLUMNS)
    weights = store(sentiment.word_weights(trained), "weights")
    texts = ["perfect", "TERRIBLE!", "i", "perfect terrible unknown", "perfect perfect terrible", "unknown"]
    examples = spark.createDataFrame([(t, t) for t in texts], "id string, body string")
    scored = sentiment.predict_ratings(examples, weights, "id", "body").collect()
    assert {r["id"]: r["predicted_rating"] for r in scored} == {
        "perfect": 5.0,
        "TERRIBLE!": 1.0,
        "i": 3.0,
        "perfect terrible unknown": 3.0,
        "perfect perfect terrible": pytest.approx(11 / 3),
        "unknown": None,
    }


@pytest.mark.parametrize("options", PLANS)
def test_every_review_is_predicted_by_itself(reviews, options):
    """Whatever its identifier: repeated, repeated with the same text, or absent."""
    trained = reviews([("a", 5, "good"), ("b", 1, "bad")], COLUMNS)
    weights = store(sentiment.word_weights(trained), "weights")
    rows = [("1", None, "good"), ("1", None, "bad bad"), (None, None, "good bad"), (None, None, "new"), ("1", None, "good")]
    rows += [(None, None, None), (None, None, " ")]
    found = sentiment.predict_ratings(reviews(rows, COLUMNS), weights, **options).collect()
    expected = [("1", 5.0), ("1", 1.0), (None, 3.0), (None, None), ("1", 5.0), (None, None), (None, None)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_column_names_do_not_make_reviews_counted(reviews):
    table = reviews(random_rows()[:300], COLUMNS)
    named = table.withColumns({name: F.lit(100) for name in ("n_reviews", "n_words", "word")})
    for report in (sentiment.word_weights, sentiment.word_total):
        assert sorted(map(str, report(named).collect())) == sorted(map(str, report(table).collect()))


def test_stop_words_are_cleaned(reviews):
    table = reviews([("1", 5, "don't go")], COLUMNS)
    found = sentiment.word_weights(table, filter_words=True, stop_words=["Don't"]).collect()
    assert {r["word"] for r in found} == {"go"}
