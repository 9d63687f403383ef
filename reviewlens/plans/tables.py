"""Review tables derived from the given test tables, one row for each of theirs.

Every mapping is a projection of one table, so that a query over it costs what it would cost over
stored reviews. FIXTURES.md lists the expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.schema import DEFAULT_HEADLINES, REVIEW_SCHEMA, conform
from reviewlens.sources.files import spread

# The columns read of each table. Given the types, opening a table costs no job of its own.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, html string",
    "benchmark": "item_id bigint, text string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _flag(condition: Column) -> Column:
    return F.when(condition, "Y").otherwise("N")


def _stars(number: Column) -> Column:
    """One to five stars."""
    return (1 + number % 5).cast("int")


def votes_table(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as reviews without text, each under the default headline of its rating; a third of
    them are in one category."""
    line = read_table(spark, folder, "lineitem")
    total = F.col("l_quantity").cast("int") - 1
    helpful = total - F.col("l_orderkey") % (total + 1)
    other = F.concat(F.lit("Category_"), (F.col("l_partkey") % 43).cast("string"))
    star = _stars(F.col("l_orderkey") + F.col("l_linenumber"))
    return line.select(
        F.when(F.col("l_suppkey") % 4 == 0, "DE").otherwise("US").alias("marketplace"),
        F.col("l_orderkey").cast("string").alias("customer_id"),
        F.when(F.col("l_partkey") % 3 == 0, "Health_&_Personal_Care").otherwise(other).alias("product_category"),
        star.alias("star_rating"),
        helpful.cast("int").alias("helpful_votes"),
        total.alias("total_votes"),
        _flag(F.col("l_returnflag") == "R").alias("vine"),
        _flag(F.col("l_linestatus") == "O").alias("verified_purchase"),
        F.element_at(F.array(*[F.lit(title) for title in DEFAULT_HEADLINES]), star).alias("review_headline"),
        F.col("l_shipdate").cast("date").alias("review_date"),
    )


def text_table(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as reviews whose body and headline are both the text."""
    documents = read_table(spark, folder, "documents")
    return documents.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("source").alias("product_category"),
        _stars(F.col("n_chars")).alias("star_rating"),
        F.col("text").alias("review_headline"),
        F.col("text").alias("review_body"),
    )


def conversation_table(spark: SparkSession, folder: str) -> DataFrame:
    """`conversations` as reviews with bodies."""
    turns = read_table(spark, folder, "conversations")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("review_id"),
        F.col("role").alias("product_category"),
        _stars(F.col("conv_id") + F.col("turn")).alias("star_rating"),
        F.col("text").alias("review_body"),
    )


def page_table(spark: SparkSession, folder: str) -> DataFrame:
    """`pages` as reviews whose bodies hold markup."""
    pages = read_table(spark, folder, "pages")
    return pages.select(
        F.col("page_id").cast("string").alias("review_id"),
        F.lit("pages").alias("product_category"),
        _stars(F.col("page_id")).alias("star_rating"),
        F.col("html").alias("review_body"),
    )


def as_reviews(df: DataFrame) -> DataFrame:
    """`df` with the review columns it lacks as nulls."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in REVIEW_SCHEMA if f.name not in df.columns}
    return conform(df.withColumns(absent))


def spread_text(spark: SparkSession, folder: str) -> DataFrame:
    """`text_table` on all cores, for the reports that take texts apart."""
    return spread(text_table(spark, folder))
