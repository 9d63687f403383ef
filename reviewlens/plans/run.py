"""All reports of a review dataset, written as Parquet.

    python -m reviewlens.plans.run REVIEWS OUT [--tsv] [--category-from-file] [--bad fail|drop|keep|store]
                                   [--stop-words FILE] [--marketplace US]

A run that failed goes on where it stopped when it is started again over the same files with the same
options (see `reviewlens.sources.publish`).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from reviewlens.functions.text import default_stop_words, read_stop_words
from reviewlens.operators import ratings, sentiment, words
from reviewlens.plans.session import name_folder
from reviewlens.schema import Counted
from reviewlens.sources import files, publish

Reports = dict[str, Callable[[], DataFrame]]


def rating_reports(reviews: DataFrame) -> Reports:
    """The reports on ratings and votes, each made when called. All but the ranking of reviews come from
    one stored cube, so the reviews are read twice and not once per report."""

    @cache
    def cube() -> Counted:
        return Counted(files.store(ratings.rating_cube(reviews), "cube"))

    def of(report: Callable[[Counted], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: report(cube())

    return {
        "category_counts": of(ratings.category_counts),
        "total_count": of(ratings.total_count),
        "category_mean": of(ratings.category_mean),
        "rating_histogram": of(ratings.rating_histogram),
        "rating_histogram_wide": of(ratings.rating_histogram_wide),
        "histogram_mean": of(lambda c: ratings.histogram_mean(ratings.rating_histogram(c))),
        "verified_means": of(ratings.verified_means),
        "verified_gap": of(lambda c: ratings.verified_gap(ratings.verified_means(c))),
        "verified_gap_overall": of(lambda c: ratings.verified_gap_overall(ratings.verified_gap(ratings.verified_means(c)))),
        "verified_margins": of(ratings.verified_margins),
        "verified_rating_counts": of(ratings.verified_rating_counts),
        "verified_rating_share": of(ratings.verified_rating_share),
        "helpfulness_ratio": of(ratings.helpfulness_ratio),
        "helpfulness_mean_ratio": of(ratings.helpfulness_mean_ratio),
        "vine_contrast": of(ratings.vine_contrast),
        "top_helpful": lambda: ratings.top_helpful(reviews),
    }


def text_reports(reviews: DataFrame, stop_words) -> Reports:
    """The reports on words and the ratings they predict, each made when called. Those on bodies come from
    one stored count, so bodies are taken apart once to learn and once to score."""

    @cache
    def counts() -> DataFrame:
        return files.store(words.word_counts(reviews), "word-counts")

    @cache
    def vocabulary() -> sentiment.Vocabulary:
        return sentiment.store_vocabulary(sentiment.word_weights(Counted(counts())))

    return {
        "top_words": lambda: words.rank_words_with_overall(words.telling_words(counts(), stop_words), 10),
        "top_headline_words": lambda: words.top_headline_words(reviews, stop_words=stop_words),
        "word_weights": lambda: vocabulary().table,
        "word_total": lambda: sentiment.word_total(Counted(counts())),
        "predicted_ratings": lambda: sentiment.predict_ratings(reviews, vocabulary()),
    }


def _converted(spark: SparkSession, run: publish.Run, options: argparse.Namespace) -> str:
    """The place of the reviews as Parquet, converted from tab-separated files."""
    from_file = options.category_from_file
    if options.bad != "store":
        read = lambda: files.read_tsv(spark, options.reviews, from_file, bad=options.bad)
        return run.put("reviews", read, files.write_parquet)

    def split(_: None, place: str) -> None:
        found = files.split_tsv(spark, options.reviews, f"{place}/reviews", f"{place}/bad_lines", from_file)
        print(f"{found.n_reviews} reviews, {found.n_bad} bad lines")

    return run.put("lines", lambda: None, split) + "/reviews"


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Write all reports of a review dataset.")
    parser.add_argument("reviews", help="folder or glob of review files")
    parser.add_argument("out", help="folder for the reports")
    parser.add_argument("--tsv", action="store_true", help="tab-separated files, converted once to OUT/reviews")
    parser.add_argument("--category-from-file", action="store_true", help="categories are those in the names of the files")
    parser.add_argument(
        "--bad",
        choices=("fail", "drop", "keep", "store"),
        default="fail",
        help="bad lines: stop, leave them out, read what can be read, or set them aside in OUT/lines/bad_lines",
    )
    parser.add_argument("--stop-words", help="text file of one stop word per line")
    parser.add_argument("--marketplace", help="keep reviews of this marketplace only")
    options = parser.parse_args(args)

    spark = SparkSession.builder.appName("reviewlens").getOrCreate()
    name_folder(spark)
    chosen = {k: v for k, v in vars(options).items() if k not in ("reviews", "out")}
    run = publish.Run(spark, options.out, publish.run_name(spark, options.reviews, **chosen))
    try:
        reviews = files.read_parquet(spark, _converted(spark, run, options) if options.tsv else options.reviews)
        if options.marketplace:
            reviews = ratings.in_marketplace(reviews, options.marketplace)
        stop_words = read_stop_words(spark, options.stop_words) if options.stop_words else default_stop_words()
        reports = {**rating_reports(reviews), **text_reports(reviews, stop_words)}
        for name, make in reports.items():
            run.put(name, make)
        run.end([*reports, *([("lines" if options.bad == "store" else "reviews")] if options.tsv else [])])
    finally:
        files.release(spark)


if __name__ == "__main__":
    main()
