
from __future__ import annotations

import functools
import sys
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from reviewlens.functions.text import (  # noqa: E402
    category_from_file_name,
    count_words,
    explode_words,
    normalise_category,
)
from reviewlens.functions import sql  # noqa: E402
from reviewlens.operators import dictionary, frequent, ratings, sentiment, words  # noqa: E402
from reviewlens.plans import tables  # noqa: E402
from reviewlens.plans.session import name_folder, ship_package  # noqa: E402
from reviewlens.schema import REVIEW_SCHEMA, Counted  # noqa: E402
from reviewlens.sources import cubes, files, publish  # noqa: E402

# The parameter of the word reports here and in the SQL below.
STOP_WORDS = ["and", "by", "in", "is", "of", "on", "that", "the", "to", "with", "la", "le", "und", "der", "que", "el"]


try:
    import corpus_pipeline
    from reviewlens.llm import queries as llm
except ImportError as absent:
    # The reports stand by themselves, whatever the corpus operators lack.
    if absent.name not in ("corpus_pipeline", "reviewlens.llm"):
        warnings.warn(f"no corpus queries: {absent}", stacklevel=1)
    llm = None


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """`query` in a session with a folder for intermediates, whose Python workers have the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        name_folder(spark)
        ship_package(spark)
        return query(spark, folder)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Counts, means and rating distribution of every category, in one pass over the reviews."""
    return ratings.category_summary(tables.votes_table(spark, "/root/testdata/sf0.001"))


def _votes(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: report(tables.votes_table(spark, folder))


def _texts(report: Callable[..., DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: report(tables.spread_text(spark, folder), **options)


def _verified_reviews(spark: SparkSession, folder: str) -> DataFrame:
    tables.votes_table(spark, folder).createOrReplaceTempView("reviews")
    return spark.sql(
        "SELECT customer_id, star_rating, verified_purchase FROM reviews WHERE verified_purchase = 'Y'"
    )


def _marketplace_filter(reviews: DataFrame) -> DataFrame:
    columns = ("customer_id", "product_category", "star_rating", "helpful_votes", "total_votes")
    return ratings.in_marketplace(reviews).select(*columns)


def _verified_gap_overall(reviews: DataFrame) -> DataFrame:
    overall = ratings.verified_gap_overall(ratings.verified_gap(ratings.verified_means(reviews)))
    return overall.select(F.round("mean_gap", 6).alias("mean_gap"))


def _verified_grouping_sets(reviews: DataFrame) -> DataFrame:
    """The margins with a word in place of the nulls of their keys."""
    return ratings.verified_margins(reviews).fillna("(all)", ["product_category", "verified_purchase"])


def _helpfulness_mean_ratio(reviews: DataFrame) -> DataFrame:
    report = ratings.helpfulness_mean_ratio(reviews)
    return report.withColumn("mean_helpful_ratio", F.round("mean_helpful_ratio", 6))


def _rating_cube(reviews: DataFrame) -> DataFrame:
    cube = ratings.rating_cube(reviews)
    return cube.withColumn("helpful_share", F.round("helpful_share", 6))


def _category_spelling(reviews: DataFrame) -> DataFrame:
    """Counts per category in one spelling; spelt after a first count, once per category."""
    counts = ratings.category_counts(reviews)
    spelt = counts.withColumn("product_category", normalise_category(F.col("product_category")))
    return ratings.category_counts(Counted(spelt))


def _category_from_file(reviews: DataFrame) -> DataFrame:
    """Counts per category, read back from the names of the files that reviews would come in."""
    country = F.lower("marketplace")
    name = F.concat(
        F.lit("data_reviews_"), country, F.lit("_"), F.col("product_category"), F.lit("_v1_00.tsv.gz")
    )
    files_of = reviews.groupBy(name.alias("name")).agg(F.count("*").alias("n_reviews"))
    # Tied to the count, or the optimizer moves the filter below it and parses a name for every review.
    category = F.when(F.col("n_reviews") > 0, category_from_file_name(F.col("name")))
    parsed = files_of.withColumn("product_category", category)
    return ratings.category_counts(Counted(parsed.where(F.col("product_category").isNotNull())))


def _category_from_read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per category of reviews written as named files and read back, of one marketplace of two."""
    path = files.new_folder(spark, "named")
    files.write_named_tsv(tables.as_reviews(tables.votes_table(spark, folder)), path)
    return ratings.category_counts(files.read_tsv(spark, path, category_from_file=True))


def _tsv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files some of which have a field too many or a rating in words: reviews and bad lines as they
    were set apart, and as they were counted on the way."""
    votes = tables.as_reviews(files.spread(tables.votes_table(spark, folder)))
    customer = F.col("customer_id").cast("bigint")
    fields = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in REVIEW_SCHEMA}
    fields["star_rating"] = F.when(customer % 89 == 1, "five").otherwise(fields["star_rating"])
    line = F.concat_ws("\t", *fields.values())
    line = F.when(customer % 97 == 0, F.concat(line, F.lit("\tand more"))).otherwise(line)
    path = files.new_folder(spark, "lines")
    votes.select(line.alias("value")).write.option("compression", "gzip").text(path)
    found = files.split_tsv(spark, path, files.new_folder(spark, "reviews"), files.new_folder(spark, "bad"))
    counted = spark.createDataFrame([("counted", "reviews", found.n_reviews), ("counted", "bad", found.n_bad)], "kind string, slice string, n long")
    too_long = F.when(F.col("line").endswith("\tand more"), "fields").otherwise("rating")
    return files.union_parts(
        [
            found.reviews.groupBy(F.lit("reviews").alias("kind"), F.col("product_category").alias("slice")).agg(F.count("*").alias("n")),
            found.bad.groupBy(F.lit("bad").alias("kind"), too_long.alias("slice")).agg(F.count("*").alias("n")),
            counted,
        ]
    )


def _cube_by_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The cube of three parts, one of which was there with other reviews before and one of which went."""
    votes = tables.votes_table(spark, folder)
    third = F.col("customer_id").cast("bigint") % 3
    path = files.new_folder(spark, "cubes")
    cubes.put_part(votes.where(third != 1), path, "0")
    cubes.put_part(votes.where(third == 0), path, "gone")
    for part in range(3):
        cubes.put_part(votes.where(third == part), path, str(part))
    cubes.put_part(votes.where(F.lit(False)), path, "gone")
    cube = ratings.rating_cube(cubes.read_parts(spark, path))
    return cube.withColumn("helpful_share", F.round("helpful_share", 6))


def _report_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """Two reports of a run that fails between them and is started again."""
    votes = tables.votes_table(spark, folder)
    path = files.new_folder(spark, "reports")
    fails = iter([True])

    def histogram() -> DataFrame:
        if next(fails, False):
            raise InterruptedError
        return ratings.rating_histogram(votes)

    reports = {"category_counts": lambda: ratings.category_counts(votes), "rating_histogram": histogram}
    try:
        publish.publish(spark, path, "run", reports)
    except InterruptedError:
        publish.publish(spark, path, "run", reports)
    counts, stars = (spark.read.parquet(f"{path}/{name}") for name in publish.manifest(spark, path)["reports"])
    slices = (F.col("product_category"), F.concat_ws("/", "product_category", "star_rating"))
    return files.union_parts(df.select(s.alias("slice"), "n_reviews") for df, s in zip((counts, stars), slices))


def _coded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The texts by number, and their dictionary."""
    texts = tables.spread_text(spark, folder)
    listed = files.store(dictionary.word_dictionary(words.word_counts(texts, by=["star_rating"])), "dictionary")
    return dictionary.code_reviews(texts, listed), listed


def _top_words_by_number(spark: SparkSession, folder: str) -> DataFrame:
    coded, listed = _coded(spark, folder)
    return dictionary.coded_top_words(dictionary.coded_word_counts(coded), listed, stop_words=STOP_WORDS)


def _word_weights_by_number(spark: SparkSession, folder: str) -> DataFrame:
    coded, listed = _coded(spark, folder)
    weights = dictionary.spelt(dictionary.coded_weights(coded), listed)
    return weights.select("word", F.round("avg_rating", 6).alias("avg_rating"), "n_words")


def _predict_rating_by_number(spark: SparkSession, folder: str) -> DataFrame:
    coded, _ = _coded(spark, folder)
    predicted = dictionary.coded_predictions(coded, files.store(dictionary.coded_weights(coded), "weights"))
    return predicted.withColumn("predicted_rating", F.round("predicted_rating", 6))


def _sql_top_words(spark: SparkSession, folder: str) -> DataFrame:
    """`top_words` in SQL, with the functions of this package and its parameters. An outer explode, as Spark
    would otherwise test the words of each text before it, and take the text apart twice."""
    sql.register(spark)
    tables.spread_text(spark, folder).createOrReplaceTempView("texts")
    return spark.sql(
        """
        WITH split AS (
          SELECT product_category, star_rating, review_words(review_body) AS words
          FROM texts WHERE star_rating BETWEEN 1 AND 5),
        exploded AS (SELECT product_category, star_rating, explode_outer(words) AS word FROM split),
        counted AS (
          SELECT product_category, star_rating, word, count(*) AS n_words FROM exploded
          WHERE is_telling_word(word) AND NOT array_contains(:stop_words, word)
          GROUP BY product_category, star_rating, word),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY product_category, star_rating ORDER BY n_words DESC, word) AS rank
          FROM counted)
        SELECT product_category, star_rating, rank, word, n_words FROM ranked WHERE rank <= :k""",
        args={"k": 10, "stop_words": STOP_WORDS},
    )


def _union_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews and words per category over three tables."""
    parts = [table(spark, folder) for table in (tables.conversation_table, tables.page_table, tables.text_table)]
    columns = ["product_category", "review_body"]
    union = files.spread(files.union_parts([part.select(columns) for part in parts]))
    return _reviews_and_words(union)


def _top_words_stop_table(spark: SparkSession, folder: str) -> DataFrame:
    """The words of another table's texts as stop words."""
    texts = tables.read_table(spark, folder, "benchmark").select("text")
    return words.top_words(tables.spread_text(spark, folder), stop_words=explode_words(texts, "text"))


def _reports_from_cube(reviews: DataFrame) -> DataFrame:
    """Votes, margins and shares, all out of one stored cube."""
    cube = Counted(files.store(ratings.rating_cube(reviews), "cube"))
    margins = ratings.verified_margins(cube).fillna("(all)", ["product_category", "verified_purchase"])
    parts = [
        (ratings.helpfulness_ratio(cube), "helpful_ratio", ["star_rating"]),
        (ratings.helpfulness_mean_ratio(cube), "mean_helpful_ratio", ["star_rating"]),
        (margins, "mean_rating", ["product_category", "verified_purchase"]),
        (ratings.verified_rating_share(cube), "share_pct", ["verified_purchase", "star_rating"]),
    ]
    return files.union_parts(
        df.select(F.lit(value).alias("report"), F.concat_ws("/", *keys).alias("slice"), F.round(value, 6).alias("value"))
        for df, value, keys in parts
    )


def _report_sink(spark: SparkSession, folder: str) -> DataFrame:
    """A report of a stored cube, written as one and read back."""
    path = files.new_folder(spark, "report")
    cube = Counted(files.store(ratings.rating_cube(tables.votes_table(spark, folder)), "cube"))
    files.write_report(ratings.category_summary(cube), path)
    return spark.read.parquet(path)


def _predict_rating_repeated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations, many of which share an identifier, rated one by one."""
    turns = tables.read_table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("review_id"), F.col("text").alias("review_body")
    )
    weights = files.store(sentiment.word_weights(tables.spread_text(spark, folder)), "weights")
    predicted = sentiment.predict_ratings(turns, weights)
    return predicted.withColumn("predicted_rating", F.round("predicted_rating", 6))


def _reviews_and_words(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_category").agg(
        F.count("*").alias("n_reviews"), F.sum(count_words(F.col("review_body"))).alias("n_words")
    )


def _tsv_source(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written as compressed tab-separated files, read back and counted."""
    path = files.new_folder(spark, "tsv")
    files.write_tsv(tables.as_reviews(tables.spread_text(spark, folder)), path)
    return _reviews_and_words(files.read_tsv(spark, path))


def _parquet_source(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written as Parquet by category, read back and counted."""
    path = files.new_folder(spark, "parquet")
    files.write_parquet(tables.as_reviews(tables.votes_table(spark, folder)), path)
    return ratings.rating_histogram_wide(files.read_parquet(spark, path))


def _word_weights(reviews: DataFrame, **options) -> DataFrame:
    weights = sentiment.word_weights(reviews, **options)
    return weights.withColumn("avg_rating", F.round("avg_rating", 6))


def _predict_rating(reviews: DataFrame, **options) -> DataFrame:
    weights = sentiment.word_weights(reviews)
    by_parts = options.get("max_broadcast_bytes") == 0
    weights = sentiment.store_vocabulary(weights) if by_parts else files.store(weights, "weights")
    predicted = sentiment.predict_ratings(reviews, weights, **options)
    return predicted.withColumn("predicted_rating", F.round("predicted_rating", 6))


def _top_headline_words(spark: SparkSession, folder: str) -> DataFrame:
    """Headlines of the texts and of the votes, the latter all default ones."""
    columns = ["product_category", "star_rating", "review_headline"]
    parts = [tables.spread_text(spark, folder), tables.votes_table(spark, folder)]
    reviews = files.union_parts([part.select(columns) for part in parts])
    return words.top_headline_words(reviews, stop_words=STOP_WORDS)


def _top_word_lists(reviews: DataFrame) -> DataFrame:
    lists = words.top_word_lists(reviews, stop_words=STOP_WORDS)
    return lists.withColumn("words", F.array_join("words", " "))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "distinct_categories": _votes(ratings.distinct_categories),
        "category_counts": _votes(ratings.category_counts),
        "total_count": _votes(ratings.total_count),
        "category_mean": _votes(ratings.category_mean),
        "category_summary": _votes(ratings.category_summary),
        "rating_cube": _votes(_rating_cube),
        "rating_histogram": _votes(ratings.rating_histogram),
        "rating_histogram_wide": _votes(ratings.rating_histogram_wide),
        "histogram_mean": _votes(lambda df: ratings.histogram_mean(ratings.rating_histogram(df))),
        "marketplace_filter": _votes(_marketplace_filter),
        "verified_reviews": _verified_reviews,
        "unverified_reviews": _votes(lambda df: ratings.purchases(df, "N")),
        "verified_means": _votes(ratings.verified_means),
        "verified_gap": _votes(lambda df: ratings.verified_gap(ratings.verified_means(df))),
        "verified_gap_overall": _votes(_verified_gap_overall),
        "verified_grouping_sets": _votes(_verified_grouping_sets),
        "verified_rating_counts": _votes(ratings.verified_rating_counts),
        "verified_rating_share": _votes(ratings.verified_rating_share),
        "helpfulness_ratio": _votes(ratings.helpfulness_ratio),
        "helpfulness_mean_ratio": _votes(_helpfulness_mean_ratio),
        "vine_contrast": _votes(ratings.vine_contrast),
        "top_helpful": _votes(ratings.top_helpful),
        "top_words": _texts(words.top_words, stop_words=STOP_WORDS),
        "top_words_no_numbers": _texts(words.top_words, stop_words=STOP_WORDS, drop_numbers=True),
        "top_words_stop_table": _top_words_stop_table,
        "top_words_overall": _texts(words.top_words_overall, stop_words=STOP_WORDS),
        "top_word_lists": _texts(_top_word_lists),
        "top_headline_words": _top_headline_words,
        "word_weights": _texts(_word_weights),
        "word_weights_filtered": _texts(_word_weights, filter_words=True, stop_words=STOP_WORDS),
        "word_total": _texts(sentiment.word_total),
        "predict_rating": _texts(_predict_rating),
        "predict_rating_by_parts": _texts(_predict_rating, max_broadcast_bytes=0),
        "predict_rating_repeated_ids": _predict_rating_repeated_ids,
        "reports_from_cube": _votes(_reports_from_cube),
        "report_sink": _report_sink,
        "union_parts": _union_parts,
        "category_spelling": _votes(_category_spelling),
        "category_from_file": _votes(_category_from_file),
        "tsv_source": _tsv_source,
        "parquet_source": _parquet_source,
        "category_from_read_files": _category_from_read_files,
        "top_words_by_buckets": _texts(frequent.top_words, stop_words=STOP_WORDS),
        "top_words_by_number": _top_words_by_number,
        "word_weights_by_number": _word_weights_by_number,
        "predict_rating_by_number": _predict_rating_by_number,
        "tsv_quarantine": _tsv_quarantine,
        "cube_by_parts": _cube_by_parts,
        "report_rerun": _report_rerun,
        "sql_top_words": _sql_top_words,
    }
    if llm is not None:
        found |= {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    return {name: _ready(query) for name, query in found.items()}


# The mappings of reviewlens/plans/tables.py, in SQL.
_VOTES = """
votes AS (
  SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'DE' ELSE 'US' END AS marketplace,
         CAST(l_orderkey AS VARCHAR) AS customer_id,
         CASE WHEN l_partkey % 3 = 0 THEN 'Health_&_Personal_Care'
              ELSE 'Category_' || CAST(l_partkey % 43 AS VARCHAR) END AS product_category,
         CAST(1 + (l_orderkey + l_linenumber) % 5 AS INTEGER) AS star_rating,
         CAST(CAST(l_quantity AS INTEGER) - 1 - l_orderkey % CAST(l_quantity AS INTEGER) AS INTEGER)
           AS helpful_votes,
         CAST(l_quantity AS INTEGER) - 1 AS total_votes,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS vine,
         CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS verified_purchase
  FROM lineitem)"""

_TEXTS = """
texts AS (
  SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS product_category,
         CAST(1 + n_chars % 5 AS INTEGER) AS star_rating, text AS review_headline, text AS review_body
  FROM documents)"""

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words_of(text: str) -> str:
    spaced = f"regexp_replace(replace({text}, '<br />', ' '), '{_SPACE}', ' ', 'g')"
    clean = f"lower(regexp_replace({spaced}, '[,.!?'']', '', 'g'))"
    return f"regexp_extract_all({clean}, '[^ ]+')"


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FORM = r"""NOT regexp_matches(word, '^[a-z]\*+$') AND regexp_matches(word, '^[a-z0-9]') AND length(word) <> 1"""
_TELLING = f"{_FORM} AND word NOT IN ({_STOP_LIST})"


def _exploded(source: str = "texts", text: str = "review_body") -> str:
    return f"""{_TEXTS},
exploded AS (
  SELECT review_id, product_category, star_rating, unnest({_words_of(text)}) AS word FROM {source})"""


def _ranked_words(by: str, k: int, telling: str = _TELLING, exploded: str = _exploded()) -> str:
    return f"""WITH {exploded},
counted AS (
  SELECT {by}, word, count(*) AS n_words FROM exploded WHERE {telling} GROUP BY {by}, word),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY n_words DESC, word) AS INTEGER) AS rank
  FROM counted)
SELECT {by}, rank, word, n_words FROM ranked WHERE rank <= {k}"""


_TITLES = "['One Star', 'Two Stars', 'Three Stars', 'Four Stars', 'Five Stars']"
_HEADLINES = f"""(
  SELECT * FROM (
    SELECT review_id, product_category, star_rating, review_headline FROM texts
    UNION ALL
    SELECT NULL, product_category, star_rating, {_TITLES}[star_rating] FROM votes)
  WHERE NOT list_contains({_TITLES}, review_headline))"""


def _weights(where: str = "true") -> str:
    return f"""weights AS (
  SELECT word, avg(star_rating) AS avg_rating, count(*) AS n_words FROM exploded WHERE {where} GROUP BY word)"""


_N_BY_STAR = ", ".join(f"count(*) FILTER (WHERE star_rating = {s}) AS n_{s}" for s in (1, 2, 3, 4, 5))
_MEANS = """avg(star_rating) AS mean_all,
  avg(star_rating) FILTER (WHERE verified_purchase = 'Y') AS mean_verified,
  avg(star_rating) FILTER (WHERE verified_purchase = 'N') AS mean_unverified"""
_GAPS = f"""{_VOTES},
means AS (SELECT product_category, {_MEANS} FROM votes GROUP BY product_category),
gaps AS (SELECT product_category, abs(mean_verified - mean_unverified) AS gap FROM means)"""

_TOP_WORDS = _ranked_words("product_category, star_rating", 10)
_TOP_WORDS_OVERALL = _ranked_words("star_rating", 10)

_CUBE = f"""WITH {_VOTES}
SELECT marketplace, product_category, star_rating, verified_purchase, vine,
       count(*) AS n_reviews, count(*) FILTER (WHERE total_votes <> 0) AS n_voted,
       round(sum(helpful_votes / nullif(total_votes, 0)), 6) AS helpful_share,
       CAST(sum(helpful_votes) AS BIGINT) AS helpful_votes,
       CAST(sum(total_votes) AS BIGINT) AS total_votes
FROM votes GROUP BY marketplace, product_category, star_rating, verified_purchase, vine"""

_CATEGORY_FROM_FILE = f"""WITH {_VOTES}
SELECT replace(product_category, '_', ' ') AS product_category, count(*) AS n_reviews
FROM votes WHERE marketplace = 'US' GROUP BY 1"""

_WORD_WEIGHTS = f"""WITH {_exploded()}, {_weights()}
SELECT word, round(avg_rating, 6) AS avg_rating, n_words FROM weights"""

_PREDICTED = f"""WITH {_exploded()}, {_weights()},
scored AS (
  SELECT review_id, avg(avg_rating) AS predicted FROM exploded JOIN weights USING (word) GROUP BY review_id)
SELECT review_id, round(predicted, 6) AS predicted_rating FROM texts LEFT JOIN scored USING (review_id)"""


def oracle_sql() -> dict[str, str]:
    """For each query that SQL can express, the same result in DuckDB's SQL."""
    found = {
        "distinct_categories": f"WITH {_VOTES} SELECT DISTINCT product_category FROM votes",
        "category_counts": f"""WITH {_VOTES}
            SELECT product_category, count(*) AS n_reviews FROM votes GROUP BY product_category""",
        "total_count": "SELECT count(*) AS n_reviews FROM lineitem",
        "category_mean": f"""WITH {_VOTES}
            SELECT product_category, avg(star_rating) AS mean_rating FROM votes GROUP BY product_category""",
        "category_summary": f"""WITH {_VOTES}
            SELECT product_category, count(*) AS n_reviews, {_MEANS}, {_N_BY_STAR}
            FROM votes GROUP BY product_category""",
        "rating_cube": _CUBE,
        "rating_histogram": f"""WITH {_VOTES}
            SELECT product_category, star_rating, count(*) AS n_reviews FROM votes
            GROUP BY product_category, star_rating""",
        "rating_histogram_wide": f"""WITH {_VOTES}
            SELECT product_category, {_N_BY_STAR} FROM votes GROUP BY product_category""",
        "histogram_mean": f"""WITH {_VOTES}
            SELECT product_category, avg(star_rating) AS mean_rating FROM votes
            GROUP BY product_category""",
        "marketplace_filter": f"""WITH {_VOTES}
            SELECT customer_id, product_category, star_rating, helpful_votes, total_votes
            FROM votes WHERE marketplace = 'US'""",
        "verified_reviews": f"""WITH {_VOTES}
            SELECT customer_id, star_rating, verified_purchase
            FROM votes WHERE verified_purchase = 'Y'""",
        "unverified_reviews": f"""WITH {_VOTES}
            SELECT customer_id, star_rating, verified_purchase
            FROM votes WHERE verified_purchase = 'N'""",
        "verified_means": f"WITH {_VOTES} SELECT product_category, {_MEANS} FROM votes GROUP BY product_category",
        "verified_gap": f"WITH {_GAPS} SELECT product_category, gap FROM gaps",
        "verified_gap_overall": f"WITH {_GAPS} SELECT round(avg(gap), 6) AS mean_gap FROM gaps",
        "verified_grouping_sets": f"""WITH {_VOTES}
            SELECT coalesce(votes.product_category, '(all)') AS product_category,
                   coalesce(votes.verified_purchase, '(all)') AS verified_purchase,
                   CAST(grouping(votes.product_category) AS INTEGER) AS all_categories,
                   CAST(grouping(votes.verified_purchase) AS INTEGER) AS all_purchases,
                   count(*) AS n_reviews, avg(star_rating) AS mean_rating
            FROM votes GROUP BY GROUPING SETS ((votes.product_category, votes.verified_purchase),
                                               (votes.product_category), (votes.verified_purchase), ())""",
        "verified_rating_counts": f"""WITH {_VOTES}
            SELECT verified_purchase, count(*) AS n_reviews, {_N_BY_STAR} FROM votes GROUP BY verified_purchase""",
        "verified_rating_share": f"""WITH {_VOTES},
            slices AS (SELECT verified_purchase, star_rating, count(*) AS n_reviews FROM votes
                       GROUP BY verified_purchase, star_rating)
            SELECT *, round(CAST(100 * n_reviews AS DOUBLE) / sum(n_reviews) OVER (), 1) AS share_pct FROM slices""",
        "helpfulness_ratio": f"""WITH {_VOTES}
            SELECT star_rating, CAST(sum(helpful_votes) AS BIGINT) AS helpful_votes,
                   CAST(sum(total_votes) AS BIGINT) AS total_votes,
                   sum(helpful_votes) / sum(total_votes) AS helpful_ratio
            FROM votes GROUP BY star_rating""",
        "helpfulness_mean_ratio": f"""WITH {_VOTES}
            SELECT star_rating, round(avg(helpful_votes / total_votes), 6) AS mean_helpful_ratio
            FROM votes WHERE total_votes <> 0 GROUP BY star_rating""",
        "vine_contrast": f"""WITH {_VOTES},
            means AS (SELECT avg(star_rating) FILTER (WHERE vine = 'Y') AS mean_vine,
                             avg(star_rating) FILTER (WHERE vine = 'N') AS mean_other FROM votes)
            SELECT *, abs(mean_vine - mean_other) AS difference FROM means""",
        "top_helpful": f"""WITH {_VOTES}
            SELECT customer_id, helpful_votes, verified_purchase FROM votes
            ORDER BY helpful_votes DESC NULLS LAST, customer_id, verified_purchase LIMIT 20""",
        "top_words": _TOP_WORDS,
        "top_words_no_numbers": _ranked_words(
            "product_category, star_rating", 10, telling=f"{_TELLING} AND NOT regexp_matches(word, '^[0-9]+$')"
        ),
        "top_words_stop_table": _ranked_words(
            "product_category, star_rating",
            10,
            telling=f"""{_FORM} AND word NOT IN (
              SELECT unnest({_words_of('text')}) FROM benchmark)""",
        ),
        "top_words_overall": _TOP_WORDS_OVERALL,
        "top_word_lists": f"""
            SELECT product_category, star_rating, string_agg(word, ' ' ORDER BY rank) AS words FROM (
              SELECT product_category, star_rating, rank, word FROM ({_TOP_WORDS})
              UNION ALL
              SELECT 'Overall', star_rating, rank, word FROM ({_TOP_WORDS_OVERALL}))
            GROUP BY product_category, star_rating""",
        "top_headline_words": _ranked_words(
            "product_category, star_rating",
            3,
            exploded=f"{_VOTES}, {_exploded(_HEADLINES, 'review_headline')}",
        ),
        "word_weights": _WORD_WEIGHTS,
        "word_weights_filtered": f"""WITH {_exploded()}, {_weights(_TELLING)}
            SELECT word, round(avg_rating, 6) AS avg_rating, n_words FROM weights""",
        "word_total": f"""WITH {_exploded()}
            SELECT count(*) AS n_words FROM exploded""",
        "predict_rating": _PREDICTED,
        "predict_rating_by_parts": _PREDICTED,
        "predict_rating_repeated_ids": f"""WITH {_exploded()}, {_weights()},
            turns AS (SELECT row_number() OVER () AS n, CAST(conv_id AS VARCHAR) AS review_id, text FROM conversations),
            turn_words AS (SELECT n, unnest({_words_of("text")}) AS word FROM turns),
            scored AS (SELECT n, avg(avg_rating) AS predicted FROM turn_words JOIN weights USING (word) GROUP BY n)
            SELECT review_id, round(predicted, 6) AS predicted_rating FROM turns LEFT JOIN scored USING (n)""",
        "reports_from_cube": f"""WITH {_VOTES}
            SELECT 'helpful_ratio' AS report, CAST(star_rating AS VARCHAR) AS slice,
                   round(sum(helpful_votes) / sum(total_votes), 6) AS value FROM votes GROUP BY star_rating
            UNION ALL
            SELECT 'mean_helpful_ratio', CAST(star_rating AS VARCHAR), round(avg(helpful_votes / total_votes), 6)
            FROM votes WHERE total_votes <> 0 GROUP BY star_rating
            UNION ALL
            SELECT 'mean_rating', coalesce(product_category, '(all)') || '/' || coalesce(verified_purchase, '(all)'),
                   round(avg(star_rating), 6)
            FROM votes GROUP BY GROUPING SETS ((product_category, verified_purchase),
                                               (product_category), (verified_purchase), ())
            UNION ALL
            SELECT 'share_pct', verified_purchase || '/' || star_rating,
                   round(CAST(100 * count(*) AS DOUBLE) / sum(count(*)) OVER (), 1)
            FROM votes GROUP BY verified_purchase, star_rating""",
        "report_sink": f"""WITH {_VOTES}
            SELECT product_category, count(*) AS n_reviews, {_MEANS}, {_N_BY_STAR}
            FROM votes GROUP BY product_category""",
        "union_parts": f"""
            SELECT product_category, count(*) AS n_reviews, CAST(sum(len({_words_of('body')})) AS BIGINT) AS n_words
            FROM (SELECT role AS product_category, text AS body FROM conversations
                  UNION ALL SELECT 'pages', html FROM pages
                  UNION ALL SELECT source, text FROM documents)
            GROUP BY product_category""",
        "category_spelling": f"""WITH {_VOTES}
            SELECT trim(regexp_replace(product_category, '[_& ]+', ' ', 'g')) AS product_category,
                   count(*) AS n_reviews
            FROM votes GROUP BY 1""",
        "category_from_file": _CATEGORY_FROM_FILE,
        "category_from_read_files": _CATEGORY_FROM_FILE,
        "top_words_by_buckets": _TOP_WORDS,
        "top_words_by_number": _TOP_WORDS,
        "sql_top_words": _TOP_WORDS,
        "word_weights_by_number": _WORD_WEIGHTS,
        "predict_rating_by_number": _PREDICTED,
        "cube_by_parts": _CUBE,
        "report_rerun": f"""WITH {_VOTES}
            SELECT product_category AS slice, count(*) AS n_reviews FROM votes GROUP BY 1
            UNION ALL
            SELECT product_category || '/' || star_rating, count(*) FROM votes GROUP BY 1""",
        "tsv_quarantine": f"""WITH {_VOTES},
            lines AS (
              SELECT *, CASE WHEN CAST(customer_id AS BIGINT) % 97 = 0 THEN 'fields'
                             WHEN CAST(customer_id AS BIGINT) % 89 = 1 THEN 'rating' END AS fault FROM votes)
            SELECT 'reviews' AS kind, product_category AS slice, count(*) AS n FROM lines WHERE fault IS NULL GROUP BY 2
            UNION ALL
            SELECT 'bad', fault, count(*) FROM lines WHERE fault IS NOT NULL GROUP BY 2
            UNION ALL
            SELECT 'counted', 'reviews', count(*) FROM lines WHERE fault IS NULL
            UNION ALL
            SELECT 'counted', 'bad', count(*) FROM lines WHERE fault IS NOT NULL""",
        "tsv_source": f"""WITH {_TEXTS}
            SELECT product_category, count(*) AS n_reviews,
                   CAST(sum(len({_words_of('review_body')})) AS BIGINT) AS n_words
            FROM texts GROUP BY product_category""",
        "parquet_source": f"""WITH {_VOTES}
            SELECT product_category, {_N_BY_STAR} FROM votes GROUP BY product_category""",
    }
    if llm is not None:
        found |= llm.SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
