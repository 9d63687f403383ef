"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target / size of the source. Their
prefix sums, shifted by one random offset per source, cross an integer as often as a document is
emitted. Documents are lined up by size, so a source's words come as near its target as one document
allows, whichever offset is drawn.

A place in that line is found without gathering a source in one task: documents are counted per
(source, size, part), part being the identifier (or its hash, if it is no whole number) modulo `PARTS`; running sums over those counts give
each part its first place, and a window within a part the rest.

Nulls: a null text has size 0, a null source is a source of its own, last in order, a null
identifier comes first among documents of a size. Sources without words get none. Rows alike in
source, size and identifier are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.places import beside, field, located
from reviewlens.sources.files import store

# What a word is.
WORD = r"[^\x20\x09-\x0D]+"

# Parts that documents of one source and size are counted in.
PARTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source its size and target, in words.

    All targets together are `share` times all words, dealt by weight; what a target has over `most`
    times its source's size goes to the other sources by weight, until none is above. Each round is
    one aggregate over the sources. They are ranked by ranges of their names, each on its own.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.asc_nulls_last("source")
    ranged = store(per_source.repartitionByRange(by_name).withColumn("range", F.spark_partition_id()), "ranges")
    # One row for each range, however many sources there are.
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(by_name))
    ranked = ranged.withColumn("within", within).join(counts, "range").withColumn("place", F.col("within") + F.col("before"))
    turn = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)
    cap = most * F.col("source_size")
    listed = store(ranked.select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "sources")

    everything = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0)))
    words, open_weight = everything.first()
    level, n_capped = share * words / open_weight if open_weight else 0.0, 0
    while open_weight:
        capped = F.col("cap") <= level * F.col("weight")
        row = listed.agg(
            F.count_if(capped),
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        if row[0] == n_capped:
            break
        n_capped, given, open_weight = row
        level = (share * words - given) / open_weight if open_weight else level
    target = F.least(F.col("cap"), level * F.col("weight"))
    return listed.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) drawn once per source: the first 52 bits of a hash of its name."""
    name = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}"), name).cast("binary")), 1, 13)
    return F.conv(drawn, 16, 10).cast("double") / F.lit(float(2**52))


def _lined_up(sizes: DataFrame) -> DataFrame:
    """`sizes` with `place`, the row's number within its source by size, part and identifier."""
    cell = ["source", "size", "part"]
    counts = sizes.groupBy(*cell).agg(F.count("*").alias("n"))
    per_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    running = (Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(*running)) - F.col("n")
    per_size = per_size.select("source", "size", before.alias("size_before"))
    within = Window.partitionBy("source", "size").orderBy("part").rowsBetween(*running)
    parts = counts.withColumn("part_before", F.sum("n").over(within) - F.col("n")).drop("n")
    parts = _join(parts, per_size, ["source", "size"])
    first = parts.select(*cell, (F.col("size_before") + F.col("part_before")).alias("first"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "at"))
    placed = _join(sizes.withColumn("own", own), first, cell)
    return placed.withColumn("place", F.col("first") + F.col("own")).drop("first", "own", "part")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by `keys`, in which nulls are equal."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return left.join(renamed, condition).drop(*[f"__{k}" for k in keys])


def _taken(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    is_number = isinstance(docs.schema["__row"].dataType[key].dataType, T.IntegralType)
    number = field(key) if is_number else F.when(field(key).isNotNull(), F.xxhash64(field(key)))
    sized = docs.select(
        F.col("__at").alias("at"),
        field(key).alias("doc_id"),
        field(source).alias("source"),
        word_count(field(text)).alias("size"),
        F.coalesce(F.pmod(number, F.lit(PARTS)), F.lit(-1)).cast("int").alias("part"),
    )
    sizes = store(sized, "sizes")
    targets = store(source_targets(sizes, weights, share, most), "targets")
    placed = _join(_lined_up(sizes), targets, ["source"])
    # Nothing is expected of a source without words.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _offset(F.col("source"), seed)
    crossed = F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)
    return placed.withColumn("copies", crossed)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies (how often the mix
    takes the document) and taken (its words times that). Options: weights, share, most, seed."""
    taken = _taken(located(docs.select(key, text, source)), key, text, source, **options)
    columns = ("doc_id", "source", "size", "source_size", "target", "copies")
    return taken.select(*columns, (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as `copies` says, with its own columns."""
    places = located(docs)
    emitted = _taken(places, key, text, source, **options).where("copies > 0")
    emitted = store(emitted.select(F.col("at").alias("__at"), F.col("copies").alias("__copies")), "copies")
    chosen = beside(places, emitted, ["__at"], "__at.file")
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
