"""Document fingerprints by locally consistent parsing.

A text's bytes are grouped into phrases, the phrases' names into longer phrases, level by level until
one is left. Runs of one name are made one symbol; deterministic coin tossing then turns the names of
neighbours, which differ, into labels below six, and a phrase starts wherever a label is higher than
both beside it. Where phrases start depends on a few names around alone, so equal substrings have equal
phrases inside, wherever they stand. A phrase's name is a hash of what it holds.

A fingerprint keeps the smallest names of the long phrases (level three and up) and, of a text with few
of those, of the short ones too, in hexadecimal. Two fingerprints are as alike as the sets behind them:
the share of names in both among the smallest of either.

Nulls: a null text is an empty one, whose fingerprint is `:`. Equal texts have equal fingerprints, and
those have likeness 1. For the order of documents: larger identifiers first, which are numbers, then a null one; rows of
one identifier in order of a hash of their text, then their text. An only document is followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.bpe import strings

# Names kept of long phrases, and of short ones where there are fewer than FEW long ones.
KEPT = 32
FEW = 16
LONG_FROM = 3

# Documents that stand together in a stretch of the order, and the most stretches.
STRETCH_ROWS = 2000
MAX_STRETCHES = 10_000

# Bytes of text that are parsed together.
TOGETHER = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _next_labels(bits: int) -> np.ndarray:
    """The toss for every pair (before, own) of different labels of so many bits, as a table."""
    before, own = np.divmod(np.arange(1 << 2 * bits), 1 << bits)
    differ = before ^ own
    lowest = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ > 0, 2 * lowest + (own >> np.minimum(lowest, bits) & 1), 0).astype(np.uint8)


# Labels go from below 128 to below 14, below 8 and below 6.
_TOSSES = [(bits, _next_labels(bits)) for bits in (7, 4, 3)]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six of names that differ from the one before; `first` marks where texts begin."""
    differ = names.copy()
    differ[1:] ^= names[:-1]
    differ[first] = 1
    lowest = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)).astype(_U)
    labels = (2 * lowest + (names >> lowest & _U(1))).astype(np.uint8)
    for bits, table in _TOSSES:
        before = np.empty(len(labels), np.uint16)
        before[1:] = labels[:-1]
        # A text's first label is tossed as if a different one stood before it.
        before[first] = labels[first] ^ 1
        labels = table[before << bits | labels]
    return labels


def _group(names: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of a level's phrases and the marks of where texts begin among them."""
    n = len(names)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(names[1:], names[:-1], out=change[1:])
    change |= first
    at = np.flatnonzero(change)
    if len(at) < n:  # a run is one symbol, named by what it repeats and how often
        runs = np.diff(at, append=n).astype(_U)
        names = names[at] + (runs - _U(1)) * _U(0x9E3779B97F4A7C15)
        # Neighbours with one name, possible by chance alone, are set apart as if they differed.
        same = np.flatnonzero((names[1:] == names[:-1]) & ~change[at][1:])
        names[same + 1] ^= _U(1)
        first = first[at]
    labels = _labels(names, first)
    starts = first.copy()
    if len(names) > 2:
        peak = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
        starts[1:-1] |= peak
    where = np.flatnonzero(starts)
    phrase = np.cumsum(starts) - 1
    place = (np.arange(len(names)) - where[phrase]).astype(_U)
    parts = _mix(names + (place + _U(1)) * _U(0xD1B54A32D192ED03))
    return _mix(np.add.reduceat(parts, where) + _U(level)), first[where]


def fingerprints(texts: Sequence[bytes]) -> list[str]:
    """The fingerprint of each text, all parsed together."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(sizes)
    if not len(full):
        return [":"] * len(texts)
    names = np.frombuffer(b"".join(texts), np.uint8).astype(_U) + _U(1)
    first = np.zeros(len(names), bool)
    first[(np.cumsum(sizes) - sizes)[full]] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    level = 0
    owner = np.arange(len(full))
    while True:
        level += 1
        names, first = _group(names, first, level)
        text = owner[np.cumsum(first) - 1]
        found.append((text, names))
        # A text of one phrase is done.
        at = np.flatnonzero(first)
        single = np.diff(at, append=len(names)) == 1
        if single.all():
            break
        if single.any():
            keep = np.ones(len(names), bool)
            keep[at[single]] = False
            names, first, owner = names[keep], first[keep], owner[~single]
    long_text, long_names = (np.concatenate(x) for x in zip(*found[LONG_FROM - 1 :])) if level >= LONG_FROM else (
        np.empty(0, np.int64),
        np.empty(0, _U),
    )
    short_text, short_names = (np.concatenate(x) for x in zip(*found[: LONG_FROM - 1]))
    long_kept = _smallest(long_text, long_names, len(full))
    few = np.fromiter((len(names) < 8 * FEW for names in long_kept), bool, len(full))
    wanted = few[short_text]
    short_kept = _smallest(short_text[wanted], short_names[wanted], len(full))
    result = [":"] * len(texts)
    for i, a, b in zip(full.tolist(), long_kept, short_kept):
        result[i] = f"{a}:{b}"
    return result


def _smallest(text: np.ndarray, names: np.ndarray, n: int) -> list[str]:
    """The KEPT smallest different names of each text, in hexadecimal."""
    names = names >> _U(32)
    order = np.argsort(text.astype(_U) << _U(32) | names, kind="stable")
    text, names = text[order], names[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (names[1:] != names[:-1])
    text, names = text[new], names[new]
    begins = np.searchsorted(text, np.arange(n + 1))
    kept = np.arange(len(text)) - begins[text] < KEPT
    text, names = text[kept], names[kept]
    ends = np.searchsorted(text, np.arange(n + 1)) * 8
    digits = names.astype(">u4").tobytes().hex()
    return [digits[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, 0 to 1."""
    if one == other:
        return 1.0
    (long_a, short_a), (long_b, short_b) = (_names(x) for x in (one, other))
    if short_a and short_b:  # two short texts, told apart by all their phrases
        long_a, long_b = long_a + short_a, long_b + short_b
        n = max(KEPT, len(long_a), len(long_b))
    else:
        n = KEPT
    a, b = set(long_a), set(long_b)
    smallest = sorted(a | b)[:n]
    return sum(x in a and x in b for x in smallest) / len(smallest) if smallest else 0.0


def _names(fingerprint: str) -> tuple[list[str], list[str]]:
    parts = fingerprint.split(":")
    return tuple([part[i : i + 8] for i in range(0, len(part), 8)] for part in parts)


def edit(text: str, following: str) -> str:
    """`text` with its last third replaced by as much of the start of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _stretches(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """`docs` with `__stretch`, the number of its stretch of the order: larger identifiers have larger
    numbers, a null one -1. The boundaries are approximate quantiles; where they are does not matter."""
    n = docs.count()
    stretches = max(1, min(MAX_STRETCHES, n // STRETCH_ROWS))
    cut = [i / stretches for i in range(1, stretches)]
    bounds = docs.select(F.percentile_approx(F.col(key).cast("double"), cut, 100_000)).first()[0] if cut else None
    splits = [-float("inf"), *sorted(set(bounds or ())), float("inf")]
    numbered = docs.withColumn("__key", F.col(key).cast("double"))
    if len(splits) > 2:
        cutter = Bucketizer(splits=splits, inputCol="__key", outputCol="__number", handleInvalid="keep")
        numbered = cutter.transform(numbered)
    else:
        numbered = numbered.withColumn("__number", F.lit(0.0))
    number = F.when(F.col("__key").isNull(), -1).otherwise(F.col("__number")).cast("int")
    return numbered.withColumn("__stretch", number).drop("__key", "__number"), n


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of `docs` its fingerprint, that of its edited text (see `edit`; the next document is
    the one that follows in descending order of identifiers, the first after the last), and how alike
    its fingerprint is to that and to the next document's.

    The order is cut into stretches, sorted apart. A stretch also gets the first document of the one
    after it, as the next of its own last; a task goes through its stretches row by row.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), body, F.xxhash64(body).alias("hash"))
    numbered, n = _stretches(rows, "doc_id")
    rank = F.struct(F.coalesce("doc_id", F.lit(-(2**63))), F.col("hash"))
    firsts = numbered.groupBy("__stretch").agg(F.max(rank).alias("rank")).collect()
    firsts.sort(key=lambda r: -r["__stretch"])
    guests = [(r["rank"][0], r["rank"][1], firsts[i - 1]["__stretch"]) for i, r in enumerate(firsts)]
    schema = "__first bigint, __hash bigint, __before int"
    listed = F.broadcast(spark.createDataFrame(guests, schema))
    same = (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("__first")) & (F.col("hash") == F.col("__hash"))
    own = F.struct(F.col("__stretch").alias("stretch"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__before").alias("stretch"), F.lit(True).alias("guest"))
    placed = numbered.join(listed, same, "left").withColumn(
        "__place", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    )
    dealt = placed.select("__place.*", "doc_id", "hash", F.col("body").cast("binary").alias("body")).repartition("stretch")
    order = [F.col("stretch"), F.col("guest"), F.desc_nulls_last("doc_id"), F.desc("hash"), F.desc("body")]
    ordered = dealt.sortWithinPartitions(*order)
    return ordered.select("stretch", "guest", "doc_id", "body").mapInArrow(_follow, OUT)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of stretch; within one its documents, then the guests: copies of the one document
    that follows the last."""
    held: list[tuple] = []  # rows whose next document is not known yet, or not enough of them to parse
    size = 0
    for batch in batches:
        stretches, guests, keys = (batch.column(i).to_pylist() for i in range(3))
        for row in zip(stretches, guests, keys, strings(batch.column(3))):
            if row[1] and held and held[-1][1]:
                continue  # another copy of the guest
            held.append(row)
            size += len(row[3])
            if size > TOGETHER:
                yield _compared(held)
                held, size = held[-1:], len(row[3])
    if held:
        yield _compared(held)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """All of `rows` that are no guests, each with the row after it; the last row waits for its next."""
    texts = [row[3] for row in rows]
    at = [i for i in range(len(rows) - 1) if not rows[i][1]]
    edited = [edit(texts[i], texts[i + 1]).encode() for i in at]
    prints = fingerprints([text.encode() for text in texts] + edited)
    own, changed = prints[: len(rows)], prints[len(rows) :]
    columns = {
        "doc_id": pa.array([rows[i][2] for i in at], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([own[i] for i in at], pa.string()),
        "edited_fingerprint": pa.array(changed, pa.string()),
        "near_edited": pa.array([likeness(own[i], c) for i, c in zip(at, changed)], pa.float64()),
        "near_next": pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)
