"""Connected components of a graph of stored edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.sources.files import keep, release


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of `edges` (a, b: bigint).

    A round lets every node hang its larger neighbours, then its smaller ones, on its smallest; rounds
    grow with the logarithm of the longest path. Smallest neighbours are found with map-side partials
    and joined back, so a node of very many edges is no task of its own. Every round is written to the
    shared folder, which cuts lineage, and the round before it released.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars, path = keep(edges.where("a != b").select(larger, smaller).distinct(), "stars")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, path
        stars, path = keep(_small_star(_large_star(stars)), "stars")
        release(edges.sparkSession, [old])
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
