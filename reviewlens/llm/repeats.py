"""Removal of repeated byte strings with a collection suffix array built column by column.

A window is a string of `LENGTH` bytes of one document. Each window is filed under its anchor, that
one of its grams with the smallest hash: equal windows have equal anchors. Neighbouring windows with
one anchor make a segment. Segments whose anchor stands nowhere else cannot repeat and are dropped
after one count; those of an anchor that only ever stands in one and the same segment repeat whole.
Of the others, those stay that agree with another on half of what a window holds beside its anchor,
just before or just after it, as one of the two lies in any window. Those are compared: all segments of some anchors are a collection
of short documents, in which an anchor is one symbol, as every window of a segment holds it whole. For
these the Burrows-Wheeler transform and the common prefixes of neighbouring
suffixes are built by inserting one symbol per document each round, from its last on, reading and
writing them as sequential files. Common prefixes of as many symbols as a
window has are repeated windows.

An anchor in more different segments than a collection holds, such as a very common line, is split:
its windows are counted by a digest of their bytes.

Segments and such windows are told equal by a cryptographic digest of their bytes, 128 bits of BLAKE2b. Scratch files are a task's own: nothing else
reads them, they are deleted as the task ends, and a task that is lost makes them anew.

Nulls: a null text is an empty one. Texts shorter than a window lose nothing. Repeated rows are
different documents, so all their windows repeat. Null identifiers are kept. An empty table gives an
empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.places import beside, field, located, small_side
from reviewlens.sources.files import store

LENGTH = 200
GRAM = 64

# Segments that are compared at once, and different ones an anchor may have before it is split.
COLLECTION = 1024

# Window starts of a text that are anchored at once.
STRETCH = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[0] = 1
    return np.cumprod(steps, dtype=_U)


_UP, _DOWN = _powers(_BASE, STRETCH + 2 * LENGTH), _powers(_INVERSE, STRETCH + 2 * LENGTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbouring values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, values.max(), values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """The segments of a text, by column: first window start, number of starts, bytes before the
    anchor, its hash, hash of the half window before it and whether the segment holds that, and the same for after it."""
    codes = np.frombuffer(text, np.uint8)
    half = (length - gram + 1) // 2
    found = []
    for begin in range(0, len(codes) - length + 1, STRETCH):
        part = codes[begin : begin + STRETCH + length - 1]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * _DOWN[: len(part) - gram + 1]
        grams = _mix(grams)
        # The hash's upper bits and the place: the first of equal ones is the least.
        placed = (grams >> _U(20) << _U(20)) | np.arange(len(grams), dtype=_U)
        anchor = (_least_of_each(placed, length - gram + 1) & _U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        n, anchor = np.diff(first, append=len(anchor)), anchor[first]
        columns = [first + begin, n, anchor - first, grams[anchor]]
        for at in (anchor - half, anchor + gram):
            held = (at >= first) & (at + half <= first + n + length - 1)
            at = np.where(held, at, 0)
            columns += [(sums[at + half] - sums[at]) * _DOWN[at], held]
        found.append(columns)
    return [np.concatenate(c) for c in zip(*found)]


_PLACE = "f bigint, row bigint"
_SEGMENT = f"{_PLACE}, first int, n int, at int, anchor bigint, c1 bigint, c2 bigint, ahead bigint, behind bigint"


def _all_segments(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["f", "row", "first", "n", "at", "anchor", "c1", "c2", "ahead", "behind"]
    for batch in batches:
        files, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found, digests, owners = [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if len(text) < length:
                continue
            columns = segments(text, length, gram)
            first, n = columns[:2]
            ends = (first + n + (length - 1)).tolist()
            digests.extend([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), ends)])
            owners.append(np.full(len(first), i))
            found.append(columns)
        if not found:
            continue
        owner = np.concatenate(owners)
        first, n, at, anchor, ahead, has_ahead, behind, has_behind = (np.concatenate(x) for x in zip(*found))
        content = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [files[owner], rows[owner], *(c.astype(np.int32) for c in (first, n, at)), anchor.view(np.int64)]
        columns = [pa.array(c) for c in (*columns, content[:, 0], content[:, 1])]
        columns += [pa.array(ahead.view(np.int64), mask=~has_ahead), pa.array(behind.view(np.int64), mask=~has_behind)]
        for start in range(0, len(owner), 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(start, 1 << 16) for c in columns], names)


class Collection:
    """The Burrows-Wheeler transform of some strings and the common prefixes of neighbouring suffixes,
    kept in two files that each round reads and writes from end to end.

    After round j they cover the suffixes of up to j symbols, the ends of the strings first, in order.
    The symbol before a suffix is its entry in the transform, 0 at a string's start. As a symbol's entries
    stand in the order of the suffixes it makes, an entry's rank among all is its suffix's place after
    the next round.
    """

    def __init__(self, strings: Sequence[bytes | np.ndarray], folder: str, most: int):
        self.n, self.most = len(strings), most
        self.sizes = np.fromiter(map(len, strings), np.int64, self.n)
        joined = np.concatenate([np.asarray(memoryview(s)) for s in strings])
        times = np.bincount(joined)
        used = np.flatnonzero(times)
        self.alphabet = len(used) + 1
        self.kind = np.min_scalar_type(len(used))
        code = np.zeros(len(times), self.kind)
        code[used] = np.arange(1, self.alphabet)
        self.symbols = code[joined]
        self.ends = np.cumsum(self.sizes)
        # Opened once and written over: a file that is emptied and closed each round would wait for the disk.
        self.files = [open(Path(folder, name), "w+b", buffering=0) for name in ("transform", "prefixes")]
        self._write(self._symbol(np.arange(self.n), 0), np.zeros(self.n, np.uint8))
        self.build()

    def _symbol(self, strings: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the last j of each string, 0 where there is none."""
        at = self.ends[strings] - 1 - j
        return np.where(self.sizes[strings] > j, self.symbols[np.maximum(at, 0)], 0).astype(self.kind)

    def _read(self) -> list[np.ndarray]:
        found = []
        for file, kind in zip(self.files, (self.kind, np.uint8)):
            file.seek(0)
            found.append(np.fromfile(file, kind, self.written))
        return found

    def _write(self, *columns: np.ndarray) -> None:
        for file, column in zip(self.files, columns):
            file.seek(0)
            column.tofile(file)
        self.written = len(columns[0])

    def close(self) -> None:
        for file in self.files:
            file.close()

    def build(self) -> None:
        active, own, place = np.arange(self.n), self._symbol(np.arange(self.n), 0), np.arange(self.n)
        # The transform's entries in order of symbol and place, how many each symbol has, and which of them
        # are the last ones of the strings. It is carried along, as a sort would cost more than all else.
        order = np.argsort(own, kind="stable").astype(np.int32)
        counts = np.bincount(own, minlength=self.alphabet)
        k = np.empty(self.n, np.int64)
        k[order] = place
        for j in range(1, int(self.sizes.max()) + 1):
            transform, prefixes = self._read()
            going = own != 0
            active, own, place, k = active[going], own[going], place[going], k[going]
            before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(order) - 1)]
            has_before = (k > 0) & (transform[before] == own)
            has_after = (k + 1 < len(order)) & (transform[after] == own)
            with_before = self._common(prefixes, before, place, has_before)
            with_after = self._common(prefixes, place, after, has_after)
            new = k + self.n - counts[0]
            total = len(transform) + len(new)
            old = np.ones(total, bool)
            old[new] = False
            grown, common = np.empty(total, self.kind), np.empty(total, np.uint8)
            grown[old], common[old] = transform, prefixes
            own = self._symbol(active, j)
            grown[new] = own
            common[new] = with_before
            inner = new + 1 < total
            common[new[inner] + 1] = with_after[inner]
            self._write(grown, common)
            place = new
            moved = np.arange(total, dtype=np.int32)[old]
            order, k = self._ordered(moved.take(order, mode="clip"), counts, own, place)
            counts += np.bincount(own, minlength=self.alphabet)
        self.order, self.shift = order, self.n - counts[0]

    @staticmethod
    def _ordered(order: np.ndarray, counts: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`order`, which has `counts` entries of each symbol, with new entries, and where in it those are."""
        by_symbol = np.lexsort((place, own))
        symbols, places = own[by_symbol], place[by_symbol].astype(np.int32)
        ends = np.cumsum(counts)
        at = np.empty(len(places), np.int64)
        cuts = np.flatnonzero(np.diff(symbols, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(symbols)]):
            end = ends[symbols[a]]
            begin = end - counts[symbols[a]]
            at[a:b] = begin + order[begin:end].searchsorted(places[a:b])
        at += np.arange(len(at))
        grown, old = np.empty(len(order) + len(at), np.int32), np.ones(len(order) + len(at), bool)
        old[at] = False
        grown[old], grown[at] = order, places
        found = np.empty(len(at), np.int64)
        found[by_symbol] = at
        return grown, found

    def _common(self, prefixes: np.ndarray, low: np.ndarray, high: np.ndarray, both: np.ndarray) -> np.ndarray:
        """One more than the least common prefix between two places, 0 where there is only one; no more than `most`."""
        found = np.zeros(len(low), np.uint8)
        chosen = np.flatnonzero(both)
        if len(chosen):
            # Ranges from the last to the first: what lies between two of them is skipped.
            chosen = chosen[np.argsort(-low[chosen].astype(np.int64), kind="stable")]
            pairs = np.stack([low[chosen] + 1, high[chosen] + 1], 1).ravel()
            padded = np.append(prefixes, np.uint8(0))
            least = np.minimum.reduceat(padded, pairs)[::2]
            found[chosen] = np.minimum(least.astype(np.int64) + 1, self.most)
        return found

    def repeated(self) -> list[np.ndarray]:
        """For each string the starts of suffixes that share `most` symbols with another."""
        transform, prefixes = self._read()
        shared = prefixes >= self.most
        shared[:-1] |= prefixes[1:] >= self.most
        rank = np.empty(len(transform), np.int64)
        rank[self.order] = np.arange(len(transform))
        strings, place = np.arange(self.n), np.arange(self.n)
        hits = []
        for j in range(1, int(self.sizes.max()) + 1):
            going = transform[place] != 0
            strings, place = strings[going], rank[place[going]] + self.shift
            if j >= self.most:
                hit = strings[shared[place]]
                hits.append(np.stack([hit, self.sizes[hit] - j], 1))
        found = np.concatenate(hits) if hits else np.empty((0, 2), np.int64)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        cuts = np.searchsorted(found[:, 0], np.arange(1, self.n))
        return np.split(found[:, 1], cuts)


_RANGE = f"{_PLACE}, low int, high int"


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "row", "low", "high"])


def _with_symbols(texts: Sequence[bytes], places: Sequence[int], gram: int) -> list[np.ndarray]:
    """Each text as numbers, the gram at its place as one above those of bytes; equal grams have equal ones."""
    symbols: dict[bytes, int] = {}
    found = []
    for text, at in zip(texts, places):
        symbol = 256 + symbols.setdefault(text[at : at + gram], len(symbols))
        codes = np.frombuffer(text, np.uint8)
        found.append(np.concatenate((codes[:at], np.array([symbol], np.int32), codes[at + gram :])))
    return found


def _compare(batches: Iterator[pa.RecordBatch], length: int, gram: int, most: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the only segments of their content, from rows in order of their anchor."""
    held: list[tuple] = []

    def found() -> pa.RecordBatch:
        with tempfile.TemporaryDirectory() as folder:
            *_, places, texts = zip(*held)
            collection = Collection(_with_symbols(texts, places, gram), folder, length - gram + 1)
            starts = collection.repeated()
            collection.close()
        rows = []
        for (_, copies, f, row, first, _, _), hits in zip(held, starts):
            if copies == 1 and len(hits):
                breaks = np.flatnonzero(np.diff(hits) > 1)
                lows, highs = hits[np.r_[0, breaks + 1]], hits[np.r_[breaks, len(hits) - 1]]
                rows.extend((f, row, first + a, first + b) for a, b in zip(lows.tolist(), highs.tolist()))
        return _ranges(rows)

    for batch in batches:
        for entry in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if len(held) >= most and held[-1][0] != entry[0]:
                yield found()
                held = []
            held.append(entry)
    if held:
        yield found()


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted segments; of those of a split anchor, a row for each window, named by its hash."""
    names = ["anchor", "copies", "f", "row", "first", "at", "w1", "w2", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows = []
        for f, row, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for one in wanted:
                first, n, anchor, copies = one["first"], one["n"], one["anchor"], one["copies"]
                if one["split"]:
                    for start in range(first, first + n):
                        digest = blake2b(text[start : start + length], digest_size=16).digest()
                        w1, w2 = np.frombuffer(digest, np.int64).tolist()
                        rows.append((None, copies, f, row, start, None, w1, w2, None))
                else:
                    part = text[first : first + n + length - 1]
                    rows.append((anchor, copies, f, row, first, one["at"], None, None, part))
            if len(rows) > 1 << 14:
                yield _batch(rows, kinds, names)
                rows = []
        if rows:
            yield _batch(rows, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _merged(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of window starts of each document as the spans of bytes they cover, touching ones joined."""
    for batch in batches:
        spans = []
        for ranges in batch.column(2).to_pylist():
            covered: list[list[int]] = []
            for low, high in sorted((r["low"], r["high"]) for r in ranges):
                if covered and low <= covered[-1][1]:
                    covered[-1][1] = max(covered[-1][1], high + length)
                else:
                    covered.append([low, high + length])
            spans.append([{"start": a, "end": b} for a, b in covered])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["f", "row", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans."""
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            edges = [0, *(e for s in spans or () for e in (s["start"], s["end"])), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "spans", "kept"])


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = COLLECTION) -> DataFrame:
    """Ranges low to high of repeated windows' starts in each of `texts` (f, row, text as bytes)."""
    found = store(texts.mapInArrow(lambda b: _all_segments(b, length, gram), _SEGMENT), "segments")
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("times"),
        ((F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))).alias("same"),
    )
    # Stored, as a join splits a hot key only if what is joined comes from a shuffle and nothing else.
    anchors = store(anchors.where("times > 1").drop("times"), "anchors")
    again = store(found.join(anchors, "anchor"), "repeated-anchors")
    whole = again.where("same").select("f", "row", "first", "n")

    differ = again.where("not same").drop("same")
    content = ["anchor", "c1", "c2"]
    one = F.min(F.struct("f", "row", "first", "n", "at")).alias("one")
    sides = [F.min(side).alias(side) for side in ("ahead", "behind")]
    contents = store(differ.groupBy(*content).agg(F.count("*").alias("copies"), one, *sides), "contents")
    copied = differ.join(contents.where("copies > 1").select(content), content, "left_semi")
    whole = whole.unionByName(copied.select("f", "row", "first", "n"))
    ranges = whole.select("f", "row", F.col("first").alias("low"), (F.col("first") + F.col("n") - 1).alias("high"))

    near = [_agreeing(contents, side) for side in ("ahead", "behind")]
    near = store(near[0].unionByName(near[1]).distinct(), "agreeing")
    crowded = near.groupBy("anchor").agg(F.count("*").alias("contents")).where(F.col("contents") > most)
    crowded = store(crowded.select("anchor", F.lit(True).alias("split")), "crowded")
    split = F.coalesce("split", F.lit(False)).alias("split")
    wanted = near.join(small_side(crowded, F.lit(100)), "anchor", "left").select("one.*", "anchor", "copies", split)
    wanted = wanted.groupBy("f", "row").agg(F.collect_list(F.struct("first", "n", "at", "anchor", "copies", "split")).alias("wanted"))
    wanted = store(wanted, "wanted")
    cut_schema = f"anchor bigint, copies bigint, {_PLACE}, first int, at int, w1 bigint, w2 bigint, bytes binary"
    cut = beside(texts, wanted, ["f", "row"], "f", row_bytes=100 + 56 * F.size("wanted")).select("f", "row", "text", "wanted")
    cut = store(cut.mapInArrow(lambda b: _cut(b, length), cut_schema), "cut")

    strings = cut.where(F.col("anchor").isNotNull()).select("anchor", "copies", "f", "row", "first", "at", "bytes")
    strings = strings.repartition("anchor").sortWithinPartitions("anchor")
    compared = strings.mapInArrow(lambda b: _compare(b, length, gram, most), _RANGE)

    windows = cut.where(F.col("anchor").isNull())
    often = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("times")).where("times > 1")
    # Stored, so that the join of a window that very many documents hold is split.
    often = store(often.select("w1", "w2"), "windows")
    split = windows.where("copies = 1").join(often, ["w1", "w2"])
    split = split.select("f", "row", F.col("first").alias("low"), F.col("first").alias("high"))
    return ranges.unionByName(compared).unionByName(split)


def _agreeing(contents: DataFrame, side: str) -> DataFrame:
    """The segments that agree with another of their anchor on the half window on one side of it."""
    shared = contents.where(F.col(side).isNotNull()).groupBy("anchor", side).agg(F.count("*").alias("others"))
    found = contents.join(store(shared.where("others > 1").drop("others"), side), ["anchor", side])
    return found.select("anchor", "c1", "c2", "copies", "one")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = COLLECTION
) -> DataFrame:
    """For each row of `docs`: doc_id, text (its bytes), spans (start and end of each maximal run of bytes
    that repeated windows cover; null for none) and kept, the bytes that are left."""
    places = located(docs)
    body = F.coalesce(field(text).cast("string"), F.lit("")).cast("binary").alias("text")
    placed = places.select(field(key).alias("doc_id"), F.col("__at.file").alias("f"), F.col("__at.row").alias("row"), body)
    ranges = repeated_ranges(placed.select("f", "row", "text"), length, gram, most)
    gathered = ranges.groupBy("f", "row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    spans = gathered.mapInArrow(
        lambda b: _merged(b, length), f"{_PLACE}, spans array<struct<start: int, end: int>>"
    )
    spans = store(spans, "spans")
    joined = beside(placed, spans, ["f", "row"], "f", "left", 100 + 24 * F.size("spans")).select("doc_id", "text", "spans")
    schema = T.StructType([*joined.schema, T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_kept, schema)
