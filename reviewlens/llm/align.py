"""Alignment of two tokenizers' tokens over the bytes they share, and the statistics of their links.

Both tokenizers cover the same bytes of a text. Two pointers walk over its tokens: the tokens they stand
at overlap and are linked, and the one that ends first moves on; where both end, the text is cut into a
new group. One NumPy state vector holds the pointers of all texts of a batch, and each step moves all of
them, writes a link for each text and notes its cuts; texts that are through leave the vector. A long
text takes part as several: it is divided at byte offsets where tokens of both end.

A link's count is the number of links of the same two ids in the whole corpus. The distinct pairs of each
document are stored with their numbers, added up, and joined back; the table of pairs grows with the
vocabularies, so it is broadcast only if its size allows.

Nulls: null and empty texts, and texts whose tokens do not spell the text in one of the tokenizers, have no
tokens and no links. Repeated rows are documents of their own, each counted. An empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm import bpe
from reviewlens.llm.encoder import Encoder
from reviewlens.llm.places import field, located, small_side
from reviewlens.sources.files import store

# Tokens of the first tokenizer after which a text is divided, and bytes of text that are aligned together.
LANE = 4096
BATCH_BYTES = 2 << 20

# Bytes a pair takes in a broadcast.
PAIR_BYTES = 100


class Tokens:
    """The tokens of one tokenizer: the bytes of each id, and their decimal forms."""

    def __init__(self, bytes_of: dict[int, bytes]):
        n = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(n)]
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        # A token's id, followed by what separates it from the next.
        self.spelt = {mark: np.array([f"{i}{mark}" for i in range(n)], object) for mark in ",|;"}

    def spell(self, ids: np.ndarray, expected: bytes) -> bool:
        """True if the tokens are those bytes."""
        if self.sizes[ids].sum() != len(expected):
            return False
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())) == expected


class ByteTokenizer:
    """Byte-level BPE in the tokenizers library's JSON form; special tokens' strings are plain text."""

    def __init__(self, serialised: str):
        vocabulary = bpe.Vocabulary(json.dumps(json.loads(serialised) | {"added_tokens": []}))
        self.encoder = Encoder(vocabulary)
        self.tokens = Tokens(vocabulary.bytes_of)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return self.encoder.encode_arrays([" " + text for text in texts])


class PieceTokenizer:
    """A sentencepiece model, which puts a space before each text itself."""

    def __init__(self, serialised: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        bytes_of = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            bytes_of[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        self.tokens = Tokens(bytes_of)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(list(texts), num_threads=1)]


@cache
def _tokenizers(a: str, b: bytes) -> tuple[ByteTokenizer, PieceTokenizer]:
    """Built once in a worker, whatever the number of its tasks."""
    return ByteTokenizer(a), PieceTokenizer(b)


def divided(a: np.ndarray, b: np.ndarray, lane: int = LANE) -> list[tuple[int, int]]:
    """Numbers of tokens of A and of B up to places where tokens of both end: about every `lane` tokens of
    A, and at the end. `a` and `b` are the offsets tokens end at."""
    cuts = []
    start = lane
    while start < len(a):
        width = 32
        while True:
            ends = a[start : start + width]
            at = np.searchsorted(b, ends)
            common = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == ends)
            if len(common) or start + width >= len(a):
                break
            width *= 8
        i = start + int(common[0])  # the ends of the text are common
        cuts.append((i + 1, int(at[common[0]]) + 1))
        start = i + lane
    if not cuts or cuts[-1][0] < len(a):
        cuts.append((len(a), len(b)))
    return cuts


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of many texts at once. `ends_a` and `ends_b` are the offsets at which the tokens of all texts
    end, one text after another; `starts` and `stops` are a text's first token and the one after its last,
    by column of A and of B, the texts in order and without gaps.

    Returns for each link, text by text, its token of A, its token of B and whether both end there.
    """
    # A step is a link, and each moves one pointer at least: no text takes more steps than it has tokens.
    room = (stops - starts).sum(1)
    at = np.cumsum(room) - room
    link_a, link_b = np.full(room.sum(), -1, np.int64), np.empty(room.sum(), np.int64)
    cut = np.zeros(room.sum(), bool)
    state = np.stack([starts[:, 0], starts[:, 1], stops[:, 0], at])
    while state.shape[1]:
        a, b, stop, at = state
        end_a, end_b = ends_a[a], ends_b[b]
        link_a[at], link_b[at] = a, b
        cut[at] = end_a == end_b
        a += end_a <= end_b
        b += end_b <= end_a
        at += 1
        going = a < stop
        if not going.all():
            state = state[:, going]
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


def _groups(tokens: tuple[Tokens, Tokens], ids: Sequence[np.ndarray], ends: Sequence[np.ndarray]) -> str:
    """One text's groups: `a1,a2|b1;a3|b2,b3`. `ends` are the numbers of A and B tokens up to each cut."""
    sizes = [np.diff(e, prepend=0) for e in ends]
    spelt = []
    for own, of, counts, stop, last in zip(tokens, ids, sizes, ends, "|;"):
        out = own.spelt[","][of]
        out[stop - 1] = own.spelt[last][of[stop - 1]]
        spelt.append((out, counts))
    (a, n_a), (b, n_b) = spelt
    joined = np.empty(len(a) + len(b), object)
    before_a = np.repeat(np.cumsum(n_b) - n_b, n_a)
    before_b = np.repeat(np.cumsum(n_a), n_b)
    joined[np.arange(len(a)) + before_a] = a
    joined[np.arange(len(b)) + before_b] = b
    return "".join(joined.tolist())[:-1]


def align_texts(a: ByteTokenizer, b: PieceTokenizer, texts: Sequence[str]) -> list[dict]:
    """For each text n_a, n_b, n_groups, n_links, groups, and pairs: the ids of A and of B of its distinct
    links, and their numbers."""
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": "", "pairs": (np.empty(0, np.int64),) * 3}
    found = [none] * len(texts)
    both = []
    for i, (text, ids_a, ids_b) in enumerate(zip(texts, a.encode(texts), b.encode(texts))):
        expected = (" " + text).encode()
        # Byte-level pieces cover a text whole, so their sizes tell; what the other model normalises is compared.
        if text and a.tokens.sizes[ids_a].sum() == len(expected) and b.tokens.spell(ids_b, expected):
            both.append((i, ids_a, ids_b))
    if not both:
        return found
    all_a, all_b = (np.concatenate([x[side] for x in both]) for side in (1, 2))
    lanes, owners, ends_a, ends_b = [], [], [], []
    first_a = first_b = 0
    for n, (_, ids_a, ids_b) in enumerate(both):
        stop_a, stop_b = np.cumsum(a.tokens.sizes[ids_a]), np.cumsum(b.tokens.sizes[ids_b])
        cuts = divided(stop_a, stop_b)
        lanes += [(first_a + x, first_b + y) for x, y in cuts]
        owners += [n] * len(cuts)
        ends_a.append(stop_a)
        ends_b.append(stop_b)
        first_a += len(ids_a)
        first_b += len(ids_b)
    stops = np.array(lanes, np.int64)
    starts = np.concatenate([np.zeros((1, 2), np.int64), stops[:-1]])
    link_a, link_b, cut = lockstep(np.concatenate(ends_a), np.concatenate(ends_b), starts, stops)

    token_ends = np.cumsum([[len(x), len(y)] for _, x, y in both], axis=0)
    link_ends = np.searchsorted(link_a, token_ends[:, 0])
    before = (0, 0, 0)
    codes = all_a[link_a].astype(np.int64) << 32 | all_b[link_b]
    for (i, ids_a, ids_b), (end_a, end_b), end in zip(both, token_ends.tolist(), link_ends.tolist()):
        begin_a, begin_b, begin = before
        before = (end_a, end_b, end)
        cuts = begin + np.flatnonzero(cut[begin:end])
        stop = link_a[cuts] - begin_a + 1, link_b[cuts] - begin_b + 1
        pairs, times = np.unique(codes[begin:end], return_counts=True)
        found[i] = {
            "n_a": end_a - begin_a,
            "n_b": end_b - begin_b,
            "n_groups": len(cuts),
            "n_links": end - begin,
            "groups": _groups((a.tokens, b.tokens), (ids_a, ids_b), stop),
            "pairs": (pairs >> 32, pairs & 0xFFFFFFFF, times),
        }
    return found


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])


def _batch(keys: list[pa.Array], found: list[dict]) -> pa.RecordBatch:
    counts = [pa.array([x[c] for x in found], pa.int64()) for c in _COUNTS]
    ends = np.cumsum([0, *(len(x["pairs"][0]) for x in found)]).astype(np.int32)
    pairs = [pa.array(np.concatenate([x["pairs"][k] for x in found]).astype(np.int32)) for k in range(3)]
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(pairs, fields=list(_PAIR)))
    groups = pa.array([x["groups"] for x in found], pa.string())
    return pa.RecordBatch.from_arrays([*keys, *counts, groups, listed], ["doc_id", "f", "row", *_COUNTS, "groups", "pairs"])


def _parts(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of up to BATCH_BYTES together, one at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of `docs`: doc_id, f and row (a hash of its file's path and its place there), n_a, n_b,
    n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: the ids of each group, A's before B's) and pairs, the
    distinct linked ids a and b with the number n of their links.

    `a_path` is a byte-level BPE file of the tokenizers library, `b_path` a sentencepiece model; the driver
    alone reads them.
    """
    with open(a_path, encoding="utf-8") as file_a, open(b_path, "rb") as file_b:
        at_hand = docs.sparkSession.sparkContext.broadcast((file_a.read(), file_b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(*at_hand.value)
        for batch in batches:
            texts = bpe.strings(batch.column(3))
            for start, stop in _parts([len(t) for t in texts]):
                part = batch.slice(start, stop - start)
                yield _batch(part.columns[:3], align_texts(a, b, texts[start:stop]))

    at = [F.col("__at.file").alias("f"), F.col("__at.row").alias("row")]
    rows = located(docs).select(field(key).alias("doc_id"), *at, field(text).cast("string").cast("binary").alias("text"))
    fields = [T.StructField("doc_id", docs.schema[key].dataType), T.StructField("f", T.LongType()), T.StructField("row", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in _COUNTS]
    pair = T.StructType([T.StructField(c, T.IntegerType()) for c in "abn"])
    schema = T.StructType([*fields, T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(pair))])
    return rows.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the two ids in all documents) and best (true if no id of A has more links
    with b), from stored `alignments`."""
    links = aligned.select(F.explode("pairs").alias("pair")).select("pair.*")
    counts = store(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "link-counts")
    # One row for each id of B: no more than its vocabulary has.
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    best = (F.col("count") == F.col("highest")).alias("best")
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", best)


def link_statistics(aligned: DataFrame) -> DataFrame:
    """Stored `alignments` without their pairs, with n_best, the links whose count is the highest of
    their id of B, and count_sum, the counts of all links added up."""
    counts = store(link_counts(aligned), "scored-links")
    links = aligned.select("f", "row", F.explode("pairs").alias("pair")).select("f", "row", "pair.*")
    scored = links.join(small_side(counts, F.lit(PAIR_BYTES)), ["a", "b"])
    per_row = scored.groupBy("f", "row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    others = [c for c in aligned.columns if c != "pairs"]
    return aligned.drop("pairs").join(per_row, ["f", "row"], "left").select(*others, *zero)
