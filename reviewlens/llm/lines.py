"""Line dedup: lines that many documents hold stay in one of them.

A line's key is the line without white space at its ends, A-Z in lower case. Occurrences of keys long
enough are range-partitioned by the key's hash and sorted by it, then by document, the largest identifier
first, and by position. A task streams through its range: the first document of a key is the one that
keeps the line, and once enough documents have followed, the lines of all but the first go. As the ranges
are cut by document too, a key that a third of all documents hold spreads over many tasks; what such a
key needs from other tasks, its number of documents there and the first task that has it, is two rows a
task. The result is a bitmap of kept lines for each document, compressed, in place of its text.

A key's hash is a 128-bit BLAKE2b. Nulls: a null text is an empty one, which is one empty line; a null
identifier is the smallest. Every row is a document of its own; of rows with equal identifiers one counts as
the largest, in every run the same. A key that a document holds several times counts once, and all its lines
stay or go together. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.places import beside, field, located
from reviewlens.sources.files import store

# Code points a key must have, and documents that must hold it, for its lines to go.
LEAST_CHARACTERS = 40
LEAST_DOCUMENTS = 5

# Rows handed on at once.
ROWS_OUT = 1 << 16


def line_key(line: bytes) -> bytes:
    """The line without white space of ASCII at its ends, A-Z in lower case."""
    return line.strip().lower()


def _occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """h1, h2, doc_id, f, row, line of every line whose key is long enough."""
    names = ["h1", "h2", "doc_id", "f", "row", "line"]
    for batch in batches:
        owners, lines, digests = [], [], []
        for owner, text in enumerate(batch.column(3).to_pylist()):
            for number, line in enumerate(text.split(b"\n")):
                if len(line) < least:
                    continue
                key = line_key(line)
                if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                    owners.append(owner)
                    lines.append(number)
                    digests.append(blake2b(key, digest_size=16).digest())
        owner = pa.array(owners, pa.int64())
        hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
        columns += [batch.column(i).take(owner) for i in range(3)] + [pa.array(lines, pa.int32())]
        found = pa.RecordBatch.from_arrays(columns, names)
        for start in range(0, found.num_rows, ROWS_OUT):
            yield found.slice(start, ROWS_OUT)


_JUDGED = "f bigint, row bigint, line int, h1 bigint, h2 bigint, part int, first boolean, n_docs bigint"


def _judged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From occurrences in order: the lines that go (no hash), the lines of which only other tasks know
    whether they go (with their hash, and whether this is the key's first document here), and for the first
    and the last key of the task the number of documents that hold it here (no line)."""
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in _JUDGED.split(", ")]

    def out(rows: np.ndarray, undecided: bool, first: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(rows[:, 4].astype(np.int32))]
        if undecided:
            columns += [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(n, part, np.int32)), pa.array(first)]
        else:
            columns += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64())], names)

    def summary(key: tuple[int, int], n_docs: int) -> pa.RecordBatch:
        row = dict.fromkeys(names) | {"h1": key[0], "h2": key[1], "part": part, "n_docs": n_docs}
        return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(names, _KINDS))))

    # Of the key that was last met: its documents so far before the rows held back, the last of those
    # documents, and the rows held back until it is known whether enough documents hold the key.
    key = doc = leading = None
    n_docs = 0
    held = np.empty((0, 5), np.int64)
    for batch in batches:
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], 1)
        rows = np.concatenate([held, new])
        if not len(rows):
            continue
        if leading is None:
            leading = (int(rows[0, 0]), int(rows[0, 1]))
        same_key = np.r_[key is not None and (rows[0, :2] == key).all(), (rows[1:, :2] == rows[:-1, :2]).all(1)]
        same_doc = same_key & np.r_[doc is not None and (rows[0, 2:4] == doc).all(), (rows[1:, 2:4] == rows[:-1, 2:4]).all(1)]
        if key is not None and not same_key[0] and tuple(key) == leading:
            yield summary(leading, n_docs)
        counted = np.cumsum(~same_doc) + (n_docs if same_key[0] else 0)
        starts = np.flatnonzero(~same_key) if not same_key[0] else np.r_[0, np.flatnonzero(~same_key)]
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(rows)))
        before = np.where(starts > 0, counted[starts - 1], 0)
        rank = counted - before[group]
        total = rank[np.r_[starts[1:], len(rows)] - 1]
        opened = group == len(starts) - 1
        lead = (rows[:, :2] == leading).all(1)
        if lead.any():
            yield out(rows[lead], True, rank[lead] == 1)
            if not lead[-1]:
                yield summary(leading, int(total[group[lead][-1]]))
        waits = opened & ~lead & (total[-1] < least)
        goes = ~lead & ~waits & (rank > 1) & (total[group] >= least)
        if goes.any():
            yield out(rows[goes], False)
        held = rows[waits]
        key = rows[-1, :2].copy()
        if len(held):
            # They are read again with what follows, so nothing of their key counts yet.
            key = doc = None
            n_docs = 0
            last = (int(held[0, 0]), int(held[0, 1]), int(total[-1]))
        else:
            doc, n_docs = rows[-1, 2:4].copy(), int(rank[-1])
            last = (int(key[0]), int(key[1]), n_docs)
    if leading is not None:
        if len(held):
            rank = np.cumsum(np.r_[True, (held[1:, 2:4] != held[:-1, 2:4]).any(1)])
            yield out(held, True, rank == 1)
        yield summary(last[:2], last[2])


_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]


def _dropped(texts: DataFrame, least_characters: int, least_documents: int) -> DataFrame:
    """f, row and lines, the numbers of the lines that go, for every document that loses some."""
    key = texts.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("h1", "h2")]
        + [T.StructField("doc_id", key)]
        + [T.StructField("f", T.LongType()), T.StructField("row", T.LongType()), T.StructField("line", T.IntegerType())]
    )
    found = store(texts.mapInArrow(lambda b: _occurrences(b, least_characters), schema), "lines")
    document = [F.desc_nulls_last("doc_id"), F.desc("f"), F.desc("row")]
    ranged = found.repartitionByRange("h1", "h2", *document).sortWithinPartitions("h1", "h2", *document, "line")
    judged = ranged.select("h1", "h2", "f", "row", "line").mapInArrow(lambda b: _judged(b, least_documents), _JUDGED)
    judged = store(judged, "judged-lines")
    # At most two rows from each task, however many lines there are.
    ends = judged.where(F.col("n_docs").isNotNull()).groupBy("h1", "h2")
    ends = ends.agg(F.sum("n_docs").alias("documents"), F.min("part").alias("first_part"))
    lines = judged.where(F.col("line").isNotNull())
    elsewhere = lines.where(F.col("h1").isNotNull()).join(F.broadcast(ends), ["h1", "h2"])
    gone = (F.col("documents") >= least_documents) & ~(F.col("first") & (F.col("part") == F.col("first_part")))
    gone = lines.where(F.col("h1").isNull()).select("f", "row", "line").unionByName(elsewhere.where(gone).select("f", "row", "line"))
    return gone.groupBy("f", "row").agg(F.collect_list("line").alias("lines"))


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, f, row and the text as bytes."""
    at = [F.col("__at.file").alias("f"), F.col("__at.row").alias("row")]
    body = F.coalesce(field(text).cast("string"), F.lit("")).cast("binary").alias("text")
    return located(docs).select(field(key).alias("doc_id"), *at, body)


def pack_bitmap(dropped: list[int], n: int) -> bytes:
    """A bit for each of n lines, set if the line stays, compressed."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(packed: bytes, n: int) -> np.ndarray:
    """The lines of n that stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, lines = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        lost = pa.array([len(x or ()) for x in lines], pa.int64())
        bits = pa.array([pack_bitmap(x or [], n) for x, n in zip(lines, sizes)], pa.binary())
        names = ["doc_id", "f", "row", "n_lines", "n_dropped", "keep"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], lost, bits], names)


def _marked(placed: DataFrame, least_characters: int, least_documents: int) -> DataFrame:
    gone = store(_dropped(placed.select("doc_id", "f", "row", "text"), least_characters, least_documents), "dropped-lines")
    text = F.col("text").cast("string")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines")
    every = placed.select("doc_id", "f", "row", n_lines)
    listed = beside(every, gone, ["f", "row"], "f", "left", 100 + 4 * F.size("lines"))
    fields = [T.StructField(n, T.LongType()) for n in ("f", "row", "n_lines", "n_dropped")]
    schema = T.StructType([placed.schema["doc_id"], *fields, T.StructField("keep", T.BinaryType())])
    return listed.select("doc_id", "f", "row", "n_lines", "lines").mapInArrow(_bitmaps, schema)


def keep_bitmaps(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_characters: int = LEAST_CHARACTERS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """For each row of `docs`: doc_id, f and row (a hash of its file's path and its place there), n_lines,
    n_dropped and keep, the bitmap of the lines that stay (see `unpack_bitmap`)."""
    return _marked(_placed(docs, key, text), least_characters, least_documents)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, lost = [], [], []
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n = text.count(b"\n") + 1
            sizes.append(n)
            if packed is not None:
                keep = unpack_bitmap(packed, n)
                lost.append(n - int(keep.sum()))
                text = b"\n".join([line for line, stays in zip(text.split(b"\n"), keep.tolist()) if stays])
            else:
                lost.append(0)
            kept.append(text)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])


def drop_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_characters: int = LEAST_CHARACTERS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """For each row of `docs`: doc_id, n_lines, n_dropped and kept, its bytes without the lines that go.

    Bitmaps go to the texts, and only those of documents that lose a line; no text is shuffled.
    """
    placed = _placed(docs, key, text)
    marks = store(_marked(placed, least_characters, least_documents), "bitmaps").where("n_dropped > 0").select("f", "row", "keep")
    joined = beside(placed, marks, ["f", "row"], "f", "left", 100 + F.length("keep")).select("doc_id", "text", "keep")
    fields = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")]
    schema = T.StructType([placed.schema["doc_id"], *fields, T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_kept, schema)
