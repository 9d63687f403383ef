"""Byte-level BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

The tree's leaves are the ranks of the pairs that start at each symbol, its root the lowest. Going
down to the leftmost leaf of that rank gives the next merge; a merge changes three leaves, each
carried up in logarithmic time. Texts are cut into pieces first, as pairs across pieces never merge; the
pieces a batch of texts brings that are not in a bounded cache are merged together, each in its own tree.

Nulls: a null text is an empty one and has no ids. Bytes that are no UTF-8 are read as U+FFFD. A text
of any length is encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spaces, spelt out as libraries differ on them.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Letters and numbers of Unicode versions after the one that tokenizers knows, by their
# first and last code point. To it they are neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
_LATER = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)


def _pattern(letters: str, numbers: str, other: str) -> str:
    """The pattern that cuts text into pieces."""
    return rf"'(?:[stmd]|re|ve|ll)| ?{letters}+| ?{numbers}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


# The same pattern for texts up to U+024F, for those beyond, and for those with code points of LATER.
_LATIN, _DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECES = _pattern(f"[{_LATIN}]", f"[{_DIGITS}]", f"[^{SPACE}{_LATIN}{_DIGITS}]")
PIECES = _pattern(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]")
_L, _N = rf"[\p{{L}}--[{_LATER}]]", rf"[\p{{N}}--[{_LATER}]]"
PIECES_WITH_LATER = "(?V1)" + _pattern(_L, _N, rf"(?:(?!{_L}|{_N})[^{SPACE}])")

# Pieces whose ids a task remembers between batches, beside those of the batch at hand: half of them the
# latest, half those before, of which pieces met again stay.
CACHED_PIECES = 1 << 17

# Longest piece, in bytes, that is merged together with others.
TOGETHER = 64

# Rows of a batch that a task hands back at once.
ROWS_OUT = 512


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it is printable and
    no space, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {chr(b if b in printable else next(others)): b for b in range(256)}


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, serialised: str):
        parsed = json.loads(serialised)
        model, ids = parsed["model"], parsed["model"]["vocab"]
        byte_of = byte_characters()
        self.base = [0] * 256
        for character, byte in byte_of.items():
            self.base[byte] = ids[character]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.special = {}
        for token in parsed["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"token {token['content']!r} takes in what stands beside it")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        self._prepare()

    def _prepare(self) -> None:
        self._latin_pieces = re.compile(LATIN_PIECES).findall
        self._pieces = regex.compile(PIECES).findall
        self._pieces_with_later = regex.compile(PIECES_WITH_LATER).findall
        self._beyond_latin = re.compile("[^\x00-ɏ]").search
        self._later = re.compile(f"[{_LATER}]").search
        longest_first = sorted(self.special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._table = PairTable(self.merges)
        self._base = np.array(self.base, np.int32)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._prepare()

    def _cut(self, text: str) -> list[str]:
        """The pieces of `text`, special tokens being pieces of their own."""
        if self._specials is not None and self._specials.search(text):
            parts = self._specials.split(text)
            return [x for part in parts for x in ([part] if part in self.special else self._cut(part))]
        if not self._beyond_latin(text):
            return self._latin_pieces(text)
        return self._pieces_with_later(text) if self._later(text) else self._pieces(text)

    def _learn(self, pieces: set[str]) -> None:
        """Merges pieces not met before: short ones together by length, a long one by itself."""
        if len(self._known) > CACHED_PIECES // 2:
            self._before, self._known = self._known, {}
        new = pieces - self._known.keys()
        met = new & self._before.keys()
        self._known.update(zip(met, map(self._before.__getitem__, met)))
        special = new & self.special.keys()
        self._known.update((content, _packed([self.special[content]])) for content in special)
        new = list(new - met - special)
        raw = [piece.encode() for piece in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            self._known[new[i]] = _packed(merge_pairs([self.base[b] for b in raw[i]], self.merges))
        width = 2
        while width <= TOGETHER:
            fits = np.flatnonzero((sizes <= width) & ((sizes > width // 2) | (width == 2)))
            for start in range(0, len(fits), 1 << 14):
                part = fits[start : start + (1 << 14)].tolist()
                merged = merge_together([raw[i] for i in part], width, self._base, self._table)
                self._known.update(zip([new[i] for i in part], merged))
            width *= 2

    def encode_arrays(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text; special tokens written out in one are taken for what they are."""
        cut = [self._cut(text) for text in texts]
        self._learn(set(chain.from_iterable(cut)))
        known = self._known.__getitem__
        return [np.frombuffer(b"".join(map(known, pieces)), np.int32) for pieces in cut]

    def encode_all(self, texts: Sequence[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def merge_pairs(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges the leftmost pair of the lowest rank until no pair has one."""
    n = len(symbols)
    none = (len(merges), -1)
    width = 1 << (n - 1).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none[0]] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = merges.get((symbols[i], symbols[i + 1]), none)[0]
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(i: int, rank: int) -> None:
        node = width + i
        tree[node] = rank
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            lower = left if left <= right else right
            if tree[node] == lower:
                return
            tree[node] = lower

    while tree[1] != none[0]:
        node, rank = 1, tree[1]
        while node < width:
            node *= 2
            if tree[node] != rank:
                node += 1
        i = node - width
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = after[j]
        put(j, none[0])
        if after[i] < n:
            before[after[i]] = i
        put(i, merges.get((symbols[i], symbols[after[i]]), none)[0] if after[i] < n else none[0])
        if before[i] >= 0:
            put(before[i], merges.get((symbols[before[i]], symbols[i]), none)[0])
    return [s for s in symbols if s >= 0]


class PairTable:
    """Ranks of pairs for whole arrays of pairs: a hash table with open addressing."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.none = len(merges)
        self.merged = np.zeros(self.none + 1, np.int32)
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        ranks = np.array([rank for rank, _ in merges.values()], np.int32)
        self.merged[ranks] = [i for _, i in merges.values()]
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots[left]] < 0
            chosen, first = np.unique(slots[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[chosen], self.ranks[chosen] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` where it has none."""
        keys = a.astype(np.int64) << 32 | b
        slots = self._slots(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], self.none).astype(np.int32)
        missed = np.flatnonzero((found != keys) & (found >= 0))
        while len(missed):
            slots[missed] = (slots[missed] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[missed]]
            hit = found == keys[missed]
            ranks[missed[hit]] = self.ranks[slots[missed[hit]]]
            missed = missed[~hit & (found >= 0)]
        return ranks


def merge_together(raw: Sequence[bytes], width: int, base: np.ndarray, table: PairTable) -> list[bytes]:
    """The packed ids of many pieces of at most `width` bytes (a power of two), by the same merges as
    `merge_pairs`, a step of all at a time.

    Every piece has a tree of its own, a row of `tree`; a step takes the leftmost pair of the lowest
    rank of each piece that still has one.
    """
    n, none = len(raw), table.none
    sizes = np.fromiter(map(len, raw), np.int64, n)
    inside = np.arange(width) < sizes[:, None]
    symbols = np.full((n, width + 1), -1, np.int32)
    symbols[:, :width][inside] = base[np.frombuffer(b"".join(raw), np.uint8)]
    place = np.arange(width + 1, dtype=np.int32)
    after = np.where(place + 1 < sizes[:, None], place + 1, width).astype(np.int32)
    before = np.broadcast_to(place - 1, (n, width + 1)).astype(np.int32).copy()

    tree = np.full((n, 2 * width), none, np.int32)
    row, first = np.nonzero(inside[:, 1:])
    tree[row, width + first] = table(symbols[row, first], symbols[row, first + 1])
    half = width
    while half > 1:
        level = tree[:, half : 2 * half]
        tree[:, half // 2 : half] = np.minimum(level[:, ::2], level[:, 1::2])
        half //= 2

    tree_, symbols_, after_, before_ = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    levels = width.bit_length() - 1
    rows = np.arange(n)
    while True:
        root = tree_[rows * (2 * width) + 1]
        rows, root = rows[root != none], root[root != none]
        if not len(rows):
            break
        top, line = rows * (2 * width), rows * (width + 1)
        node = np.ones(len(rows), np.int64)
        for _ in range(levels):
            node *= 2
            node += tree_[top + node] != root
        i = node - width
        j = after_[line + i]
        k = after_[line + j]
        symbols_[line + i] = table.merged[root]
        symbols_[line + j] = -1
        after_[line + i] = k
        before_[line + k] = i
        h = before_[line + i]
        here = np.where(k < width, table(symbols_[line + i], symbols_[line + k]), none)
        ahead = h >= 0
        h = np.where(ahead, h, i)
        there = np.where(ahead, table(symbols_[line + h], symbols_[line + i]), here)
        nodes = np.stack([j + width, i + width, h + width])
        tree_[top + nodes[0]] = none
        tree_[top + nodes[1]] = here
        tree_[top + nodes[2]] = there
        for _ in range(levels):
            nodes >>= 1
            below = top + 2 * nodes
            tree_[top + nodes] = np.minimum(tree_[below], tree_[below + 1])

    kept = symbols[:, :width] >= 0
    ids = symbols[:, :width][kept].tobytes()
    ends = np.cumsum(4 * kept.sum(1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def shared(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary on every executor: a few megabytes, whatever the corpus."""
    return spark.sparkContext.broadcast(vocabulary)


def strings(column: pa.Array) -> list[str]:
    """A binary column as text, null as the empty one."""
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def encode(
    docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """doc_id, ids and, if asked for, what the ids decode to, for each row of `docs`."""
    at_hand = shared(docs.sparkSession, vocabulary)
    fields = [T.StructField("doc_id", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_encoder(at_hand, decoded), T.StructType(fields))


def _encoder(at_hand, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        vocabulary = at_hand.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                ids = vocabulary.encode_arrays(strings(part.column(1)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [part.column(0), listed]
                names = ["doc_id", "ids"]
                if decoded:
                    columns.append(pa.array([vocabulary.decode(i.tolist()) for i in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
