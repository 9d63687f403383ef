"""Streams over range-partitioned rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.sources.files import store


def _counted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their first column, with the number of rows of that value before each in the task,
    and the number of the task; after them a row for the first value of the task and one for the last, with
    how many rows of it the task has."""
    part = TaskContext.get().partitionId()
    first = last = None
    n = n_first = 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(starts, append=len(keys))
        offset = np.zeros(len(starts), np.int64)
        if last is not None and keys[0] == last:
            offset[0] = n
        if first is None:
            first = keys[0]
        numbers = np.arange(len(keys)) - np.repeat(starts - offset, sizes)
        if keys[0] == first:
            n_first = int(sizes[0] + offset[0])
        last, n = keys[-1], int(sizes[-1] + offset[-1])
        ends = [pa.array(np.full(len(keys), part, np.int32)), pa.array(numbers), pa.nulls(len(keys), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *ends], names)
        schema = batch.schema
    if first is not None:
        ends = {(int(first), n_first), (int(last), n)}
        columns = [pa.array([k for k, _ in ends], pa.int64())]
        columns += [pa.nulls(len(ends), kind) for kind in schema.types[1:]]
        columns += [pa.array([part] * len(ends), pa.int32()), pa.nulls(len(ends), pa.int64()), pa.array([c for _, c in ends], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names)


def numbered(rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """`rows`, whose `key` is a bigint and not null, with `name`: 0, 1, 2 and so on within each key, in `order`.

    Rows are range-partitioned by key and order, so that a key of very many rows spreads over tasks. Each
    counts on its own; what it lacks is how many rows of its first key came before, which is known from two
    rows of each task.
    """
    rows = rows.select(key, *[c for c in rows.columns if c != key])
    ends = [T.StructField("__part", T.IntegerType()), T.StructField(name, T.LongType()), T.StructField("__n", T.LongType())]
    schema = T.StructType([*rows.schema, *ends])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    counted = store(ranged.mapInArrow(lambda b: _counted(b, schema.names), schema), "numbered")
    sums = counted.where(F.col("__n").isNotNull()).select(F.col(key).alias("__key"), F.col("__part").alias("__p"), "__n")
    later = sums.alias("a").join(sums.alias("b"), F.expr("a.__key = b.__key AND b.__p < a.__p"))
    before = later.groupBy(F.col("a.__key"), F.col("a.__p")).agg(F.sum("b.__n").alias("__before"))
    # Of the tasks that a key spreads over, two rows each: as many as tasks, whatever the number of rows.
    found = counted.where(F.col("__n").isNull()).join(
        F.broadcast(before), (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__p")), "left"
    )
    return found.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).select(*rows.columns, name)
