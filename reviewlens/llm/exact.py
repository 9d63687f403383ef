"""Exact deduplication as a stream with keyed state on disk.

Arrivals are a table of keys: the digest of a row's text, its stable identifier and the place its
content is stored at. A streaming aggregation by digest, with RocksDB as its store and no watermark,
remembers for every digest ever seen how many rows had it and which of them is kept. Wherever a
digest was met more than once, the bytes at all its places are compared; rows whose bytes differ in
spite of one digest are grouped again by the bytes themselves.

Nulls: a null text is an empty one; a null identifier is the smallest. Of rows with equal texts and
identifiers one stays, in every run the same. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.places import beside, field, located
from reviewlens.sources.files import new_folder, store

# State on disk. A store is a partition of the state, so there are many small ones, which should not
# each set aside room for a large one.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _body(text: str) -> Column:
    return F.coalesce(field(text).cast("string"), F.lit(""))


def arrivals(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document of a `located` frame: identifier, digest, size and place of its content."""
    return docs.select(
        field(key).alias("doc_id"),
        digest(_body(text)).alias("digest"),
        F.octet_length(_body(text)).cast("bigint").alias("n_bytes"),
        F.col("__at").alias("at"),
    )


def remember(spark: SparkSession, folder: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Streams the arrivals in `folder` that `checkpoint` has not seen yet into its state, and returns
    the state: for each digest and size the number of rows and the largest (identifier, place).

    Called again with the same checkpoint after more files arrived, it goes on from there. A batch
    that fails is run again from the state before it.
    """
    schema = spark.read.parquet(folder).schema
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        seen = (
            reader.parquet(folder)
            .groupBy("digest", "n_bytes")
            .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("kept"))
        )
        query = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        value = state.schema["value"].dataType.names
        return state.select(
            F.col("key.digest").alias("digest"),
            F.col("key.n_bytes").alias("n_bytes"),
            F.col("value")[value[0]].alias("n"),
            F.col("value")[value[1]].alias("kept"),
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def decide(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """For each row of `docs` (a `located` frame): doc_id, digest, n_bytes, at, the identifier
    keep_id and place keep_at of the row that stays, and group_size."""
    spark = docs.sparkSession
    folder, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "state")
    arrivals(docs, key, text, digest).write.parquet(folder)
    state = store(remember(spark, folder, checkpoint, files_per_batch), "seen")
    arrived = spark.read.parquet(folder)
    decided = arrived.join(state, ["digest", "n_bytes"]).select(
        *arrived.columns, F.col("kept.doc_id").alias("keep_id"), F.col("kept.at").alias("keep_at"), F.col("n")
    )

    unequal = store(_unequal(docs, decided.where("n > 1"), text), "unequal")
    if unequal.isEmpty():
        return decided.withColumnRenamed("n", "group_size")
    again = decided.join(unequal, ["digest", "n_bytes"], "left_semi").drop("keep_id", "keep_at", "n")
    again = again.join(docs.select(F.col("__at").alias("at"), _body(text).alias("body")), "at")
    exact = again.groupBy("body").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("kept"))
    again = again.join(exact, "body").select(
        *arrived.columns, F.col("kept.doc_id").alias("keep_id"), F.col("kept.at").alias("keep_at"), F.col("n")
    )
    rest = decided.join(unequal, ["digest", "n_bytes"], "left_anti").select(again.columns)
    return rest.unionByName(again).withColumnRenamed("n", "group_size")


def _unequal(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    """The digests whose rows do not all hold the same bytes.

    Texts are fetched by the places of rows with a repeated digest, and equal ones merged in the task
    that read them: however many rows share a digest, a task sends its text once.
    """
    hits = store(hits.select("at", "digest", "n_bytes"), "hits")
    texts = docs.select(F.col("__at").alias("at"), _body(text).alias("body"))
    texts = beside(texts, hits, ["at"], "at.file")
    different = texts.select("digest", "n_bytes", "body").distinct()
    return different.groupBy("digest", "n_bytes").agg(F.count("*").alias("bodies")).where("bodies > 1").drop("bodies")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (the identifier of the row that stays), group_size,
    kept and text_sha256."""
    decided = decide(located(docs.select(key, text)), key, text, **options)
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("at") == F.col("keep_at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with all their columns."""
    places = located(docs)
    decided = decide(places, key, text, **options)
    dropped = store(decided.where(F.col("at") != F.col("keep_at")).select(F.col("at").alias("__at")), "dropped")
    return beside(places, dropped, ["__at"], "__at.file", "left_anti").select("__row.*")
