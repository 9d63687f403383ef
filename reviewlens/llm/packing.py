"""Packing documents into rows of token ids by best fit, decreasing.

Documents are encoded and cut into pieces of at most a row's length, in order and without loss. The
pieces are dealt over shards of a bounded number of tokens; within a shard they go, longest first,
into the fullest open row that still has room, found by a segment tree over free capacities. A row
holds its ids, the cumulative lengths of its segments, its position ids, which start again at 0 with
each segment, and where each segment comes from.

Nulls: a null text is an empty one; an empty text has no tokens and so no piece. Identifiers are of any
type that can be ordered, and a null one is kept. Pieces of equal length are taken in order of identifier and
piece; equal rows are told apart by their number within a batch and spread over shards like others. An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.bpe import Vocabulary, strings
from reviewlens.llm.encoder import Encoder

# Bytes of text behind the pieces of a shard: about half a million tokens, whatever the corpus.
SHARD_BYTES = 2 << 20

# Rows of a matrix that is written as one.
MATRIX_ROWS = 1024


def number_type(largest: int) -> np.dtype:
    """How ids and positions are stored: little-endian, in two bytes if the largest one fits."""
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


class Capacities:
    """How many open rows have each free capacity, in a segment tree that finds the least one that is
    large enough."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def least(self, size: int) -> int | None:
        """The smallest free capacity of at least `size`; None if there is none."""
        node = self.width + size
        if self.count[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(sizes: Sequence[int], length: int) -> list[list[int]]:
    """The indices of `sizes`, which fall, that go into each row of `length`."""
    rows: list[list[int]] = []
    open_rows: dict[int, list[int]] = {}
    capacities = Capacities(length)
    for i, size in enumerate(sizes):
        capacity = capacities.least(size)
        if capacity is None:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row = open_rows[capacity].pop()
            capacities.add(capacity, -1)
        rows[row].append(i)
        left = capacity - size
        if left:
            open_rows.setdefault(left, []).append(row)
            capacities.add(left, 1)
    return rows


def pack(
    docs: DataFrame, vocabulary: Vocabulary, length: int = 2048, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Packed rows of `length` ids: pack_id, n_tokens, ids, cu_seqlens, position_ids, doc_ids, pieces.

    `ids` and `position_ids` are `n_tokens` numbers each, stored as `number_type` says: a matrix row
    without its padding. Segment i of a row is piece `pieces[i]` of document `doc_ids[i]`.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    n_shards = size // SHARD_BYTES + 1
    at_hand = spark.sparkContext.broadcast(Encoder(vocabulary))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = number_type(max(vocabulary.bytes_of))
    key_type = docs.schema[key].dataType
    piece = [T.StructField("doc_id", key_type), *[T.StructField(c, T.IntegerType()) for c in ("again", "piece", "n")]]
    piece = T.StructType([*piece, T.StructField("ids", T.BinaryType())])
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, at_hand.value, length, kind), piece)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "again"), F.lit(n_shards)).alias("shard")
    dealt = pieces.select(shard, "*")
    row = T.StructType(
        [
            T.StructField("pack_id", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_ids", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(key_type)),
            T.StructField("pieces", T.ArrayType(T.IntegerType())),
        ]
    )
    return dealt.groupBy("shard").applyInArrow(lambda part: _packed(part, length), row)


def _pieces(
    batches: Iterator[pa.RecordBatch], encoder: Encoder, length: int, kind: np.dtype
) -> Iterator[pa.RecordBatch]:
    """doc_id, again (how many rows of the batch had the identifier before), piece, n and ids of every piece."""
    for batch in batches:
        met: Counter = Counter()
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            owners, times, numbers, sizes, ids = [], [], [], [], []
            encoded_texts = encoder.encode_arrays(strings(part.column(1)))
            for owner, (key, found) in enumerate(zip(part.column(0).to_pylist(), encoded_texts)):
                again = met[key]
                met[key] += 1
                encoded = found.astype(kind)
                for number, first in enumerate(range(0, len(encoded), length)):
                    piece = encoded[first : first + length]
                    owners.append(owner)
                    times.append(again)
                    numbers.append(number)
                    sizes.append(len(piece))
                    ids.append(piece.tobytes())
            columns = [part.column(0).take(pa.array(owners, pa.int64()))]
            columns += [pa.array(c, pa.int32()) for c in (times, numbers, sizes)]
            names = ["doc_id", "again", "piece", "n", "ids"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names)


def _packed(part: pa.Table, length: int) -> pa.Table:
    part = part.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    shard = part.column("shard")[0].as_py()
    sizes = part.column("n").to_pylist()
    ids, keys = part.column("ids").to_pylist(), part.column("doc_id").to_pylist()
    numbers = part.column("piece").to_pylist()
    kinds = [*_ROW_KINDS, ("doc_ids", pa.list_(part.schema.field("doc_id").type)), ("pieces", pa.list_(pa.int32()))]
    rows = []
    for row, members in enumerate(best_fit_decreasing(sizes, length)):
        ends = np.cumsum([0, *[sizes[i] for i in members]])
        rows.append(
            {
                "pack_id": (shard << 32) + row,
                "n_tokens": int(ends[-1]),
                "ids": b"".join([ids[i] for i in members]),
                "cu_seqlens": ends.tolist(),
                "position_ids": positions(ends).astype(number_type(length)).tobytes(),
                "doc_ids": [keys[i] for i in members],
                "pieces": [numbers[i] for i in members],
            }
        )
    return pa.Table.from_pylist(rows, pa.schema(kinds))


_ROW_KINDS = [
    ("pack_id", pa.int64()),
    ("n_tokens", pa.int32()),
    ("ids", pa.binary()),
    ("cu_seqlens", pa.list_(pa.int32())),
    ("position_ids", pa.binary()),
]


def positions(ends: np.ndarray) -> np.ndarray:
    """Position ids of a row of segments with cumulative lengths `ends`."""
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files, through Spark's commit, so that a lost task leaves nothing behind."""
    packed.write.parquet(path)


def matrices(packed: DataFrame, length: int, pad: int = 0, rows: int = MATRIX_ROWS) -> DataFrame:
    """Packed rows as matrices of up to `rows` rows and `length` columns: pack_ids, n_rows, ids and
    position_ids (row by row, little-endian in four bytes, padded with `pad` and with 0), cu_seqlens (of one row
    after another) and n_segments of each row."""
    kinds = [pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["pack_ids", "n_rows", "ids", "position_ids", "cu_seqlens", "n_segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows).to_pylist()
                ids, places = np.full((len(part), length), pad, "<u4"), np.zeros((len(part), length), "<u4")
                for n, row in enumerate(part):
                    for out, stored in ((ids, row["ids"]), (places, row["position_ids"])):
                        out[n, : row["n_tokens"]] = np.frombuffer(stored, f"<u{len(stored) // row['n_tokens']}")
                ends = [end for row in part for end in row["cu_seqlens"]]
                counts = [len(row["cu_seqlens"]) - 1 for row in part]
                values = [[row["pack_id"] for row in part], len(part), ids.tobytes(), places.tobytes(), ends, counts]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    schema = "pack_ids array<bigint>, n_rows int, ids binary, position_ids binary, cu_seqlens array<int>, n_segments array<int>"
    return packed.select("pack_id", "n_tokens", "ids", "cu_seqlens", "position_ids").mapInArrow(run, schema)


def read_rows(
    spark: SparkSession, path: str, length: int, pad: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Per stored row, one after another: its ids and its position ids, both padded to `length`, and its
    cumulative lengths."""
    for row in spark.read.parquet(path).toLocalIterator():
        ids, places = np.full(length, pad, np.int64), np.zeros(length, np.int64)
        for out, stored in ((ids, row["ids"]), (places, row["position_ids"])):
            out[: row["n_tokens"]] = np.frombuffer(stored, f"<u{len(stored) // row['n_tokens']}")
        yield ids, places, row["cu_seqlens"]
