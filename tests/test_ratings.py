import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import ratings
from reviewlens.schema import Counted

# Published counts of reviews by rating (1 to 5), in all, and their mean rating.
PUBLISHED = {
    "Jewelry": ([155108, 100852, 159735, 270579, 1081479], 1767753, 4.144090266004357),
    "Mobile_Electronics": ([17600, 7320, 9754, 18112, 52373], 105159, 3.763966945292367),
    "Sports": ([363373, 229593, 380838, 837570, 3043122], 4854496, 4.229267672689399),
    "Camera": ([171072, 91641, 142712, 339725, 1073802], 1818952, 4.128970967897998),
    "Major_Appliances": ([19846, 5475, 6718, 15158, 49704], 96901, 3.71618455949887),
}

# Published mean ratings of verified and of unverified purchases.
PUBLISHED_MEANS = {
    "Jewelry": (4.155366571088315, 4.05695030733911),
    "Mobile_Electronics": (3.792907017405331, 3.608553428640659),
    "Sports": (4.255905016823825, 4.028012710139385),
    "Camera": (4.179964052107881, 3.880317885929348),
    "Major_Appliances": (4.161018549453104, 2.624741606671894),
}

# Published helpful and total votes by rating.
PUBLISHED_VOTES = {
    1: (47320942, 84294626),
    2: (19272456, 30356947),
    3: (25985553, 36850248),
    4: (45763452, 56393443),
    5: (163445301, 197709783),
}


def by_category(df, column):
    return {r["product_category"]: r[column] for r in df.collect()}


@pytest.fixture
def published(spark):
    rows = [(c, s + 1, n) for c, (counts, _, _) in PUBLISHED.items() for s, n in enumerate(counts)]
    return Counted(spark.createDataFrame(rows, "product_category string, star_rating int, n_reviews long"))


def test_published_counts_and_means(published):
    counts = {c: n for c, (_, n, _) in PUBLISHED.items()}
    means = {c: m for c, (_, _, m) in PUBLISHED.items()}
    assert by_category(ratings.category_counts(published), "n_reviews") == counts
    assert ratings.total_count(published).first()["n_reviews"] == sum(counts.values())
    assert by_category(ratings.category_mean(published), "mean_rating") == means
    assert by_category(ratings.histogram_mean(ratings.rating_histogram(published)), "mean_rating") == means
    order = [r["product_category"] for r in ratings.category_counts(published).collect()]
    assert order == sorted(counts, key=counts.get)


def test_published_gaps(spark):
    rows = [(c, v, u) for c, (v, u) in PUBLISHED_MEANS.items()]
    means = spark.createDataFrame(rows, "product_category string, mean_verified double, mean_unverified double")
    gaps = ratings.verified_gap(means)
    found = by_category(gaps, "gap")
    assert found == {c: abs(v - u) for c, (v, u) in PUBLISHED_MEANS.items()}
    assert found["Major_Appliances"] == pytest.approx(1.536277, abs=1e-6)
    overall = ratings.verified_gap_overall(gaps).first()["mean_gap"]
    assert overall == pytest.approx(sum(found.values()) / len(found))


def test_published_helpfulness(spark):
    rows = [(s, h, t) for s, (h, t) in PUBLISHED_VOTES.items()]
    votes = spark.createDataFrame(rows, "star_rating int, helpful_votes long, total_votes long")
    found = [round(r["helpful_ratio"], 6) for r in ratings.helpfulness_ratio(votes).collect()]
    assert found == [0.561376, 0.634861, 0.705166, 0.811503, 0.826693]


COLUMNS = (
    "marketplace string, customer_id string, product_category string, star_rating int, helpful_votes int, "
    "total_votes int, vine string, verified_purchase string"
)


def random_rows(n=3000, seed=3):
    """A third of the reviews in one category, and nulls in every column but the customer."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        total = rng.choice([None, 0, 0, 1, 3, 50])
        helpful = None if total is None or rng.random() < 0.05 else rng.randrange(total + 1)
        rows.append(
            (
                rng.choice(["US", "US", "DE", None]),
                str(i % 700),
                "Hot" if i % 3 == 0 else rng.choice(["A", "B", "C", "D"]),
                rng.choice([1, 2, 3, 4, 5, None]),
                helpful,
                total,
                rng.choice(["Y", "N", "N", None]),
                rng.choice(["Y", "N", None]),
            )
        )
    return rows


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


@pytest.fixture(params=["reviews", "cube"])
def either(request, reviews):
    """Reviews, or the cube of the same ones: every report must give the same on both."""
    table = reviews(random_rows(), COLUMNS)
    return table if request.param == "reviews" else Counted(ratings.rating_cube(table))


def test_category_reports(either):
    groups = defaultdict(list)
    for row in random_rows():
        groups[row[2]].append(row)
    assert by_category(ratings.category_counts(either), "n_reviews") == {c: len(g) for c, g in groups.items()}
    assert ratings.total_count(either).first()["n_reviews"] == 3000
    assert set(by_category(ratings.distinct_categories(either), "product_category")) == set(groups)
    means = by_category(ratings.category_mean(either), "mean_rating")
    assert means == {c: mean(r[3] for r in g) for c, g in groups.items()}
    assert by_category(ratings.histogram_mean(ratings.rating_histogram(either)), "mean_rating") == means
    histogram = {(r[0], r[1]): r[2] for r in ratings.rating_histogram(either).collect()}
    assert histogram == {
        (c, s): n for c, g in groups.items() for s in range(1, 6) if (n := sum(r[3] == s for r in g))
    }
    summary = {r["product_category"]: r for r in ratings.category_summary(either).collect()}
    for wide in ratings.rating_histogram_wide(either).collect():
        c = wide["product_category"]
        for s in range(1, 6):
            assert wide[f"n_{s}"] == summary[c][f"n_{s}"] == histogram.get((c, s), 0)
    for row in ratings.verified_means(either).collect():
        group = groups[row["product_category"]]
        expected = [mean(r[3] for r in group)] + [mean(r[3] for r in group if r[7] == v) for v in "YN"]
        assert [row["mean_all"], row["mean_verified"], row["mean_unverified"]] == expected
        assert summary[row["product_category"]]["mean_verified"] == row["mean_verified"]


def test_margins(either):
    rows = random_rows()
    found = ratings.verified_margins(either).collect()
    for row in found:
        group = [
            r
            for r in rows
            if (row["all_categories"] or r[2] == row["product_category"])
            and (row["all_purchases"] or r[7] == row["verified_purchase"])
        ]
        assert (row["n_reviews"], row["mean_rating"]) == (len(group), mean(r[3] for r in group))
    assert len(found) == 5 * 3 + 5 + 3 + 1


def test_shares(either):
    rows = [r for r in random_rows() if r[7] and r[3]]
    found = ratings.verified_rating_share(either).collect()
    assert len(found) == 10 and sum(r["share_pct"] for r in found) == pytest.approx(100, abs=0.5)
    for row in found:
        n = sum(r[7] == row["verified_purchase"] and r[3] == row["star_rating"] for r in rows)
        assert row["n_reviews"] == n
        assert row["share_pct"] == pytest.approx(100 * n / len(rows), abs=0.0501)
    for row in ratings.verified_rating_counts(either).collect():
        side = [r for r in random_rows() if r[7] == row["verified_purchase"]]
        assert row["n_reviews"] == len(side)
        assert [row[f"n_{s}"] for s in range(1, 6)] == [sum(r[3] == s for r in side) for s in range(1, 6)]


def test_votes(either):
    rows = random_rows()
    sums = {r["star_rating"]: r for r in ratings.helpfulness_ratio(either).collect()}
    means = {r["star_rating"]: r["mean_helpful_ratio"] for r in ratings.helpfulness_mean_ratio(either).collect()}
    for s in range(1, 6):
        helpful = sum(r[4] for r in rows if r[3] == s and r[4] is not None)
        total = sum(r[5] for r in rows if r[3] == s and r[5] is not None)
        assert sums[s]["helpful_ratio"] == helpful / total
        own = [r[4] / r[5] for r in rows if r[3] == s and r[5] and r[4] is not None]
        assert means[s] == pytest.approx(mean(own))


def test_vine(either):
    rows = random_rows()
    row = ratings.vine_contrast(either).first()
    vine, other = (mean(r[3] for r in rows if r[6] == v) for v in "YN")
    assert (row["mean_vine"], row["mean_other"], row["difference"]) == (vine, other, abs(vine - other))


def test_marketplace(either):
    n = ratings.total_count(ratings.in_marketplace(either)).first()["n_reviews"]
    assert n == sum(r[0] == "US" for r in random_rows())


def test_edges(reviews):
    rows = [("US", "1", "A", None, 0, 0, "N", "Y"), ("US", "2", "B", 4, 0, 0, "N", "Y")]
    table = reviews(rows, COLUMNS)
    assert by_category(ratings.category_counts(table), "n_reviews") == {"A": 1, "B": 1}
    assert by_category(ratings.category_mean(table), "mean_rating") == {"A": None, "B": 4.0}
    assert by_category(ratings.rating_histogram(table), "n_reviews") == {"B": 1}
    assert by_category(ratings.rating_histogram_wide(table), "n_4") == {"A": 0, "B": 1}
    means = ratings.verified_means(table)
    assert by_category(means, "mean_unverified") == {"A": None, "B": None}
    assert by_category(ratings.verified_gap(means), "gap") == {"A": None, "B": None}
    assert ratings.helpfulness_ratio(table).first()["helpful_ratio"] is None
    assert ratings.helpfulness_mean_ratio(table).collect() == []
    assert ratings.vine_contrast(table).first()["difference"] is None


def test_no_reviews(reviews):
    empty = reviews([], COLUMNS)
    assert ratings.total_count(empty).first()["n_reviews"] == 0
    assert ratings.category_summary(empty).collect() == []
    assert ratings.verified_rating_share(empty).collect() == []


def test_top_helpful(reviews):
    rows = random_rows()
    table = reviews(rows, COLUMNS)
    kinds = {None: "", "N": "N", "Y": "Y"}
    expected = sorted(
        ((r[1], r[4], r[7]) for r in rows if r[4] is not None), key=lambda r: (-r[1], r[0], kinds[r[2]])
    )
    assert [tuple(r) for r in ratings.top_helpful(table, 7).collect()] == expected[:7]
    every = ratings.top_helpful(table, 5000).collect()
    assert len(every) == 3000 and every[-1]["helpful_votes"] is None


def test_purchases(reviews):
    rows = random_rows()
    for value in "YN":
        found = ratings.purchases(reviews(rows, COLUMNS), value).collect()
        assert len(found) == sum(r[7] == value for r in rows)
        assert found[0].asDict().keys() == {"customer_id", "star_rating", "verified_purchase"}


def test_cube_is_small(reviews):
    cube = ratings.rating_cube(reviews(random_rows(), COLUMNS))
    assert cube.count() <= 3 * 5 * 6 * 3 * 3
    assert cube.agg(F.sum("n_reviews")).first()[0] == 3000


REPORTS = [
    ratings.category_counts,
    ratings.total_count,
    ratings.category_mean,
    ratings.category_summary,
    ratings.rating_cube,
    ratings.rating_histogram,
    ratings.rating_histogram_wide,
    ratings.verified_means,
    ratings.verified_margins,
    ratings.verified_rating_counts,
    ratings.verified_rating_share,
    ratings.helpfulness_ratio,
    ratings.helpfulness_mean_ratio,
    ratings.vine_contrast,
]


@pytest.mark.parametrize("report", REPORTS)
def test_column_names_do_not_make_reviews_counted(reviews, report):
    table = reviews(random_rows()[:300], COLUMNS)
    named = table.withColumns({name: F.lit(100) for name in ("n_reviews", "n_voted", "helpful_share", "n_words")})
    assert sorted(map(str, report(named).collect())) == sorted(map(str, report(table).collect()))
