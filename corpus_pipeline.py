"""From raw documents to token ids, in five stages, each written and read again.

A stage takes the rows its predecessor kept and decides by itself alone: what the quality classifier
rejects goes, of equal texts one stays, of near copies one stays, sources are mixed to their weights, so
that a document may go or come twice, and what is left is encoded. All but the last return the columns
they were given; the last returns doc_id, n_tokens and ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import bpe, exact, mixing, quality, simhash
from reviewlens.llm.queries import vocabulary
from reviewlens.plans.session import name_folder
from reviewlens.sources.files import intermediates, keep, release


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the quality classifier accepts; it learns from the labels of those given."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest identifier."""
    return exact.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest identifier."""
    return simhash.drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    found = bpe.encode(docs, vocabulary())
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("simhash near-dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("bpe encoding", encoded),
]

# A classifier and fingerprints are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of `documents`. What a stage leaves behind, and its input, goes as soon as
    its result is written, or as it fails."""
    name_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(intermediates())
    kept = None
    try:
        for name, stage in STAGES:
            docs, kept = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            release(spark, [path for path in intermediates() if path not in others and path != kept])
    except BaseException:
        release(spark, [path for path in intermediates() if path not in others])
        raise
    return docs
