"""Stored cubes that grow: the counts of each part of the reviews by themselves.

A part is what arrives together, such as a file, a category or a month. Its cube is a folder of its own; to
add a part, or to replace one that has changed, costs that part's reviews and touches no other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.ratings import CUBE_KEYS, N, rating_cube
from reviewlens.schema import Counted
from reviewlens.sources.files import delete, exists, files_under

PART = "part"


def _named(part: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
        raise ValueError(f"part {part!r} cannot name a folder: letters, digits, _ . and - only")
    return part


def put_part(reviews: DataFrame, path: str, part: str, keys: Sequence[str] = CUBE_KEYS) -> int:
    """The cube of `reviews` as the part `part` of the cubes under `path`, in place of the one there, if any.
    Returns the number of reviews; a part without any leaves none.

    Only the folder of the part is replaced, as the job commits: a run that fails leaves the part as it was.
    """
    seen = Observation()
    cube = rating_cube(reviews, keys).observe(seen, F.coalesce(F.sum(N), F.lit(0)).alias(N))
    named = cube.withColumn(PART, F.lit(_named(part)))
    # A cube is a few thousand rows: one file for a part, however many tasks counted it.
    writer = named.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PART).parquet(path)
    found = seen.get[N]
    if not found:
        drop_part(reviews.sparkSession, path, part)
    return found


def drop_part(spark: SparkSession, path: str, part: str) -> None:
    delete(spark, f"{path}/{PART}={_named(part)}")


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The parts under `path`, in order, from the names of their folders."""
    found = {re.search(rf"/{PART}=([^/]+)/", file) for file in files_under(spark, path)} if exists(spark, path) else set()
    return sorted({match[1] for match in found if match})


def read_parts(spark: SparkSession, path: str) -> Counted:
    """All parts as counted rows, from which every report is made as from one cube."""
    if not parts_of(spark, path):
        raise FileNotFoundError(f"no part under {path}")
    return Counted(spark.read.parquet(path).drop(PART))
