"""Rows told apart by the place they are stored at."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.sources.files import store

# Above this size a list of rows is not broadcast whole.
MAX_BROADCAST_BYTES = 64 << 20

# Bytes a row of such a list takes in a task's hash table.
ROW_BYTES = 100

# Files whose hashes have the same first bits are read together.
RANGES = 1 << 12


def _one_row_per_place(docs: DataFrame) -> bool:
    """True if `docs` is a file table under nothing but projections and filters that always choose alike:
    what explodes, joins, unions or samples may show a stored row several times, or another time not."""
    node = docs._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().location().rootPaths().size() == 1  # one path named twice is read twice


def located(docs: DataFrame) -> DataFrame:
    """`docs` as two columns: `__at`, the file and row its content is stored at, and `__row`, all its own
    columns in a struct, so that no name of theirs can clash. A file is named by a hash of its path; a corpus
    has far too few files for two to share one.

    `docs` is a stored table read as it is, perhaps filtered or projected, or else it is stored first.
    """
    if not _one_row_per_place(docs):
        docs = store(docs, "documents")
    place = docs.metadataColumn("_metadata")
    at = F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
    return docs.select(at.alias("__at"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))


def field(name: str) -> Column:
    """A column of a `located` frame's rows."""
    return F.col("__row").getField(name)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(rows: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """A stored list, to be broadcast if it is small enough: `row_bytes` a row, ROW_BYTES where it holds
    a place alone."""
    size = rows.agg(F.coalesce(F.sum(F.lit(ROW_BYTES) if row_bytes is None else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(rows) if size <= MAX_BROADCAST_BYTES else rows


def beside(
    docs: DataFrame, rows: DataFrame, on: Sequence[str], file: str, how: str = "inner", row_bytes: Column | None = None
) -> DataFrame:
    """`docs`, read from files and told apart by `on`, joined to a stored list of `rows` without moving them.

    `file` is the expression, of both, that names a file by its hash. A list small enough is broadcast. A
    larger one is cut by files into parts that are; each part is broadcast to a reading of its own files
    alone, as Spark passes over files by such a condition when it lists them. A list that is too large for one
    file's rows is cut by row as well, and the file read as often. So the list, of any size, goes to the
    documents, and no document is shuffled.
    """
    of_file, size = F.expr(file), F.lit(ROW_BYTES) if row_bytes is None else row_bytes
    range_of = F.shiftright(of_file, 64 - RANGES.bit_length() + 1)
    sizes = rows.groupBy(range_of.alias("range")).agg(F.sum(size).alias("bytes")).orderBy("range").collect()
    if not sizes or sum(r["bytes"] for r in sizes) <= MAX_BROADCAST_BYTES:
        return docs.join(F.broadcast(rows), list(on), how)
    # Neighbouring ranges up to the limit; the first and the last part reach to the ends, as all files are read.
    parts: list[list[int]] = []
    for row in sizes:
        if parts and parts[-1][2] + row["bytes"] <= MAX_BROADCAST_BYTES:
            parts[-1][1:] = [row["range"], parts[-1][2] + row["bytes"]]
        else:
            parts.append([row["range"], row["range"], row["bytes"]])
    joined = []
    for i, (first, _, held) in enumerate(parts):
        lower = None if i == 0 else range_of >= first
        upper = None if i == len(parts) - 1 else range_of < parts[i + 1][0]
        inside = lower if upper is None else upper if lower is None else lower & upper
        own, listed = (docs, rows) if inside is None else (docs.where(inside), rows.where(inside))
        times = -(-held // MAX_BROADCAST_BYTES) if MAX_BROADCAST_BYTES > 0 else 1
        for n in range(times):
            # Of a part too large, which is one range of files, the rows whose places leave the remainder n.
            chosen = F.lit(True) if times == 1 else F.pmod(F.xxhash64(*[F.col(c) for c in on]), F.lit(times)) == n
            joined.append(own.where(chosen).join(F.broadcast(listed.where(chosen)), list(on), how))
    return reduce(DataFrame.unionByName, joined)
