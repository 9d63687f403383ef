"""SimHash near-duplicates by a tiled exact comparison of all fingerprints.

A text's words, A-Z in lower case, make shingles; each shingle's XXH64 votes on 64 bits, and a bit is
set if more than half of them have it. Equal fingerprints are one; the distinct ones are laid out in
tiles by their population count. Two tiles are compared if their counts differ by no more than the
radius, as no two of their fingerprints can be closer otherwise: by exclusive-or and bit counts over
numpy blocks. A pair of tiles hands back the edges of a spanning forest of its links, so a dense group
costs as many rows as it has members, and the components come from those.

The work is the square of the number of distinct fingerprints, by a small factor; no link is missed.

Nulls: a null text is an empty one. A text without words has fingerprint zero, linked like any other; one
with fewer words than a shingle is one shingle. Null identifiers belong to a component but never name
it, unless it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.components import components
from reviewlens.llm.places import beside, field, located
from reviewlens.sources.files import store

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42

# Fingerprints of a tile, and of a block of its rows that is compared at once.
TILE = 1 << 12
BLOCK = 1 << 6


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64 bits of a text as a signed number."""
    words = text.lower().split()  # both of ASCII alone: A-Z, and the spaces between words
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = (stops - sizes)[: len(words) - width + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(bits), 255):
        votes += bits[start : start + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > len(bits)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """`docs` without its text, with `__print`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or b"", width) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__print"])

    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("__print", T.LongType())])
    return docs.select(*others, F.col(text).cast("string").cast("binary").alias("__text")).mapInArrow(run, schema)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints `fp` at most `radius` bits apart that connect whatever is
    linked: a spanning forest for each pair of tiles.

    Tiles are numbered by population count, as many to a count as its fingerprints fill. Only those 65
    counts come to the driver. A tile is sent to each partner it can have links with.
    """
    counted = prints.groupBy(F.bit_count("fp").alias("ones")).agg(F.count("*").alias("n")).collect()
    tiles = [0] * 65
    for row in counted:
        tiles[row["ones"]] = -(-row["n"] // tile)
    first = np.concatenate([[0], np.cumsum(tiles)]).tolist()

    def lookup(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.bit_count("fp") + 1)

    within = F.pmod(F.xxhash64("fp"), F.greatest(lookup(tiles), F.lit(1)))
    numbered = prints.select("fp", (lookup(first[:65]) + within).alias("tile"))
    numbered = numbered.withColumns(
        {
            "from": lookup([first[max(0, p - radius)] for p in range(65)]),
            "to": lookup([first[min(64, p + radius) + 1] - 1 for p in range(65)]),
        }
    )
    filled = numbered.groupBy("tile", "from", "to").agg(F.collect_list("fp").alias("fps"))
    partner = F.explode(F.sequence("from", "to")).alias("partner")
    sent = filled.select("tile", "fps", partner).select(
        F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"), "fps"
    )
    return sent.groupBy("a", "b").applyInArrow(lambda pair: _compare(pair, radius), "a bigint, b bigint")


def _compare(pair: pa.Table, radius: int) -> pa.Table:
    tiles = [np.array(fps, np.int64) for fps in pair.column("fps").to_pylist()]
    if len(tiles) == 1 and pair.column("a")[0] != pair.column("b")[0]:
        tiles.append(np.empty(0, np.int64))  # the partner holds no fingerprint
    edges = forest(tiles[0], tiles[-1], radius)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of fingerprints, one from each side, that span the links between the sides."""
    nodes = np.unique(np.concatenate([left, right]))
    root = np.arange(len(nodes))
    a, b = left.view(np.uint64), right.view(np.uint64)
    right_at = np.searchsorted(nodes, right)
    found = []
    bits, apart, near = (np.empty((BLOCK, len(b)), kind) for kind in (np.uint64, np.uint8, bool))
    for start in range(0, len(a), BLOCK):
        part = a[start : start + BLOCK, None]
        n = len(part)
        np.bitwise_xor(part, b, out=bits[:n])
        np.bitwise_count(bits[:n], out=apart[:n])
        np.less_equal(apart[:n], radius, out=near[:n])
        row, column = np.divmod(np.flatnonzero(near[:n]), len(b))
        u, v = np.searchsorted(nodes, left[start + row]), right_at[column]
        while True:  # hang the larger root on the smaller, until both ends of each link have one
            unjoined = root[u] != root[v]
            u, v = u[unjoined], v[unjoined]
            if not len(u):
                break
            high, low = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
            high, chosen = np.unique(high, return_index=True)
            found.append(np.stack([nodes[u[chosen]], nodes[v[chosen]]], 1))
            root[high] = low[chosen]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _grouped(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints of rows, and the component of each fingerprint that has links."""
    distinct = store(rows.select(F.col("__print").alias("fp")).distinct(), "fingerprints")
    edges = store(links(distinct, radius), "links")
    return distinct, components(edges)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest identifier of those reachable by
    links, for each row of `docs`."""
    rows = store(fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__body")), "__body", width), "prints")
    placed = _components_of(rows, radius, F.min("doc_id").alias("component_id"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"), "component_id")


def _components_of(rows: DataFrame, radius: int, chosen: Column) -> DataFrame:
    """`rows` with what `chosen` finds over all rows of a component.

    Rows are added up by fingerprint first, so only distinct fingerprints meet in a component.
    """
    distinct, rooted = _grouped(rows, radius)
    roots = distinct.join(rooted, F.col("fp") == F.col("node"), "left")
    roots = store(roots.select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    with_root = rows.join(roots, F.col("__print") == F.col("fp")).drop("fp")
    per_root = store(with_root.groupBy("root").agg(chosen), "components")
    return with_root.join(per_root, "root")


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """The rows of `docs` that stay, one of each component: the one with the smallest identifier, a null
    one last, and of those one, in every run the same."""
    places = located(docs)
    body = places.select(F.col("__at").alias("at"), field(key).alias("doc_id"), field(text).alias("__body"))
    rows = store(fingerprints(body, "__body", width), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("least")
    placed = _components_of(rows, radius, least)
    dropped = placed.where(F.col("at") != F.col("least.at")).select(F.col("at").alias("__at"))
    dropped = store(dropped, "dropped")
    return beside(places, dropped, ["__at"], "__at.file", "left_anti").select("__row.*")
