"""Language identification as inference of a multilingual mixture.

A model holds, for each language, the probability of every hashed byte trigram. A document is taken
for a mixture: expectation-maximisation finds the proportions of a set of languages that make its
trigrams most likely, and the set grows by the next strongest language as long as the penalised
likelihood does. The document's language is the one of the largest proportion.

Nulls: a document whose text is null or has no letter is `und`, with score 0; a null language teaches
nothing. Without any training document all are `und`. Of languages with equal proportions the first by
name is taken. A null identifier is in the training fold. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.sources.files import store

UNKNOWN = "und"

# Trigrams are hashed to as many buckets; a model takes four bytes for each of them and each language.
BUCKETS = 1 << 16
MAX_MODEL_BYTES = 256 << 20

# Count added to every bucket of every language.
SMOOTHING = 0.5

# Overlapping trigrams repeat each other's evidence: one in so many counts in the likelihood.
OVERLAP = 3

ROUNDS = 12
LETTER = regex.compile(r"\p{L}")


def trigrams(text: bytes) -> np.ndarray:
    """The buckets of the byte trigrams of a text between two spaces."""
    codes = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    mixed = (codes[:-2] | codes[1:-1] << 8 | codes[2:] << 16) * np.uint32(2654435761)
    return (mixed >> 16).astype(np.uint16)


def _lowered(raw: bytes | None) -> bytes:
    """The text in lower case, as UTF-8; empty if it has no letter."""
    text = (raw or b"").decode("utf-8", "replace")
    return text.lower().encode() if LETTER.search(text) else b""


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # one row per bucket, one column per language

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray) -> Model:
        smoothed = counts + SMOOTHING
        return cls(languages, (smoothed / smoothed.sum(0)).astype(np.float32))

    def proportions(self, text: bytes) -> tuple[list[int], np.ndarray]:
        """The languages of a lower-case text and their proportions."""
        grams = np.sort(trigrams(text))
        edges = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        count = np.diff(np.r_[edges, len(grams)]).astype(np.float32)
        likely = self.probability[grams[edges]]
        n = len(grams) / OVERLAP
        alone = count @ np.log(likely) / OVERLAP
        chosen, shares, best = [int(np.argmax(alone))], np.ones(1), float(alone.max())
        if len(self.languages) == 1:
            return chosen, shares
        together = mixture(likely, count)
        by_share = [i for i in np.argsort(-together, kind="stable").tolist() if i not in chosen]
        for language in by_share:
            columns = [*chosen, language]
            part = likely[:, columns]
            found = mixture(part, count)
            reached = float(count @ np.log(part @ found)) / OVERLAP
            if reached - best <= 0.5 * np.log(max(n, 2.0)):
                break
            chosen, shares, best = columns, found, reached
        return chosen, shares

    def identify(self, raw: bytes | None) -> tuple[str, float, str]:
        """Language, its proportion, and the whole mixture, strongest first."""
        text = _lowered(raw)
        if not text or not self.languages:
            return UNKNOWN, 0.0, ""
        chosen, shares = self.proportions(text)
        ranked = sorted(zip(shares.tolist(), chosen), key=lambda x: (-x[0], self.languages[x[1]]))
        mixed = " ".join(f"{self.languages[i]}:{share:.3f}" for share, i in ranked)
        share, first = ranked[0]
        return self.languages[first], min(1.0, max(0.0, share)), mixed


def mixture(likely: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The proportions of the columns of `likely` that make the counted rows most likely."""
    shares = np.full(likely.shape[1], 1 / likely.shape[1], np.float32)
    total = count.sum()
    for _ in range(ROUNDS):
        updated = shares * ((count / (likely @ shares)) @ likely) / total
        done = np.abs(updated - shares).max() < 1e-3
        shares = updated
        if done:
            break
    return (shares / shares.sum()).astype(np.float64)


def fold(key: Column, n: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the trigrams of all of `docs` that have a language.

    A task adds up its documents; per task one row per language and bucket it saw is shuffled, and the
    sums, bounded by languages times buckets, make the model on the driver.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _raw(text))
    counted = known.mapInArrow(_count, "lang string, bucket int, n bigint")
    sums = store(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    n_languages = sums.select("lang").distinct().count()
    if 4 * BUCKETS * n_languages > MAX_MODEL_BYTES:
        raise ValueError(f"{n_languages} languages: a model of {BUCKETS} buckets each is too large to broadcast")
    found = sums.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    columns = [number[name] for name in found.column("lang").to_pylist()]
    counts[found.column("bucket").to_numpy(), columns] = found.column("n").to_numpy()
    return Model.of(languages, counts)


def _raw(text: str) -> Column:
    return F.col(text).cast("string").cast("binary").alias("text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def counted():
        for name, counts in sums.items():
            seen = np.flatnonzero(counts)
            columns = [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = _lowered(raw)
            if not text:
                continue
            if name not in sums:
                if len(sums) == 64:  # a task holds the counts of so many languages at once
                    yield from counted()
                    sums.clear()
                sums[name] = np.zeros(BUCKETS, np.int64)
            sums[name] += np.bincount(trigrams(text), minlength=BUCKETS)
    yield from counted()


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's proportion) and mixture of each row of `docs`."""
    at_hand = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [at_hand.value.identify(raw) for raw in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.string())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "mixture"])

    names = {"lang_pred": T.StringType(), "score": T.DoubleType(), "mixture": T.StringType()}
    fields = [T.StructField("doc_id", docs.schema[key].dataType), *[T.StructField(n, t) for n, t in names.items()]]
    return docs.select(F.col(key).alias("doc_id"), _raw(text)).mapInArrow(run, T.StructType(fields))
