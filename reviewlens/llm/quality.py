"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A document becomes a vector of statistics, as logarithms or shares. Each class has a mean and a
covariance, the latter shrunk towards the pooled one, by a share that is chosen on folds of the sample, and
that towards its diagonal; the score is the logistic of the difference of the two log-densities, each a Mahalanobis distance computed with a cached
Cholesky factor. It is fitted on a bounded sample of labelled documents, a fixed number of each class,
taken in order of a hash of the identifier; every document is scored.

Nulls: a null text is an empty one and is scored as such. Labels other than 0 and 1 and documents
without one teach nothing; of documents that share an identifier and its label one teaches. With fewer than two documents of either class every score is 0.5 or, if
only one class is known, the share of that class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.places import free_name

# Labelled documents of each class that the fit takes.
SAMPLE_PER_CLASS = 20_000

# Shares of the pooled covariance in a class's own that are tried, on so many folds of the sample, and the
# share of its diagonal in the pooled one.
SHRINK_TO_POOLED = (0.05, 0.2, 0.4, 0.7, 1.0)
TRIED_FOLDS = 4
SHRINK_TO_DIAGONAL = 0.1

# What shares are added to before their logarithm is taken.
SMALL = 0.01

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "space": b" \t",
    "line": b"\n",
}
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _n, _members in enumerate(_CLASSES.values()):
    _MEMBERS[list(_members), _n] = 1

FEATURES = 14


def features(text: bytes) -> list[float]:
    """The statistics of a text: its size, shares of kinds of characters, repetition, word length, entropy."""
    n = len(text)
    if n == 0:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, stop, bang, bar, symbol, space, line = (counts @ _MEMBERS).tolist()
    share = counts[counts > 0] / n
    words = text.split()
    n_words = max(1, len(words))
    repeated = sum(map(eq, words, words[1:]))
    letters = sum(map(len, words))
    return [
        np.log1p(n),
        np.log(SMALL + upper / max(1.0, upper + lower)),
        np.log(SMALL + symbol / n),
        np.log(SMALL + bang / n),
        np.log(SMALL + bar / n),
        np.log(SMALL + digit / n),
        np.log(SMALL + stop / n_words),
        np.log(SMALL + line / n_words),
        np.log(SMALL + repeated / (n_words + 8)),
        np.log(max(1, len(set(words)))) / np.log(n_words + 1),
        np.log1p(letters / n_words),
        space / n,
        (counts[128:].sum()) / n,
        float(-(share * np.log(share)).sum()),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of the classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    prior: float

    @classmethod
    def fit(cls, vectors: np.ndarray, labels: np.ndarray, prior: float) -> Discriminant | float:
        """The discriminant, or the one score there is where a class has fewer than two vectors."""
        sizes = np.bincount(labels, minlength=2)
        if sizes.min() < 2:
            return prior if sizes.min() == 0 and sizes.max() else 0.5
        shrink = SHRINK_TO_POOLED[len(SHRINK_TO_POOLED) // 2]
        if sizes.min() >= 4 * TRIED_FOLDS:
            shrink = min(SHRINK_TO_POOLED, key=lambda tried: cls._loss(vectors, labels, prior, tried))
        return cls._fit(vectors, labels, prior, shrink)

    @classmethod
    def _loss(cls, vectors: np.ndarray, labels: np.ndarray, prior: float, shrink: float) -> float:
        """The logarithmic loss of each fold under the discriminant of the others, all added up. The vectors
        of a class are dealt over folds in turn."""
        turn = np.empty(len(labels), np.int64)
        for c in (0, 1):
            turn[labels == c] = np.arange((labels == c).sum()) % TRIED_FOLDS
        total = 0.0
        for fold in range(TRIED_FOLDS):
            own = turn == fold
            score = cls._fit(vectors[~own], labels[~own], prior, shrink).score(vectors[own])
            right = np.where(labels[own] == 1, score, 1 - score)
            total -= np.log(np.maximum(right, 1e-12)).sum()
        return float(total)

    @classmethod
    def _fit(cls, vectors: np.ndarray, labels: np.ndarray, prior: float, shrink: float) -> Discriminant:
        sizes = np.bincount(labels, minlength=2)
        scale = vectors.std(0) + 1e-6
        means = np.stack([vectors[labels == c].mean(0) for c in (0, 1)])
        own = [np.cov((vectors[labels == c] / scale).T) for c in (0, 1)]
        pooled = sum(c * n for c, n in zip(own, sizes)) / sizes.sum()
        pooled = (1 - SHRINK_TO_DIAGONAL) * pooled + SHRINK_TO_DIAGONAL * np.diag(np.diag(pooled))
        floor = 1e-3 * np.eye(vectors.shape[1])
        factors = [np.linalg.cholesky((1 - shrink) * c + shrink * pooled + floor) for c in own]
        whiten = np.stack([np.linalg.inv(f) / scale for f in factors])
        log_det = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return cls(means, whiten, log_det, np.log([1 - prior, prior]), prior)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        log_density = [
            self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (((vectors - self.means[c]) @ self.whiten[c].T) ** 2).sum(1)
            for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def fold(key: Column, n: int) -> Column:
    """The fold of a row by its identifier as text; null for a null one."""
    return F.crc32(key.cast("string")) % n


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 3,
    left_out: int = 1,
    per_class: int = SAMPLE_PER_CLASS,
) -> Discriminant | float:
    """Learns from the labelled documents outside the fold `left_out`.

    The sample's identifiers, at most `per_class` of each class, are broadcast to the documents; their
    vectors, a few megabytes, come back.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(fold(F.col(key), folds) != left_out)
    known = known.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label"))
    share = known.agg(F.avg("__label")).first()[0]
    order = [F.xxhash64("__key"), "__key", "__label"]
    sample = [known.where(F.col("__label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = docs.select(F.col(key).alias("__key"), _text(docs, text).alias("__text")).join(
        F.broadcast(sample[0].unionByName(sample[1])), "__key"
    )
    key_type = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("label", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
    )
    vectors = chosen.select("__key", "__label", "__text").mapInArrow(_vectors, schema)
    # However many documents share an identifier, one vector for each label of the sample comes back.
    vectors = vectors.groupBy("key", "label").agg(F.min("vector").alias("vector")).select("label", "vector").toArrow()
    found = np.array(vectors.column("vector").to_pylist()).reshape(-1, FEATURES)
    classes = np.array(vectors.column("label").to_pylist(), dtype=np.int64)
    order = np.lexsort([*found.T, classes])  # sums do not depend on the order rows come in
    return Discriminant.fit(found[order], classes[order], 0.5 if share is None else share)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], vectors], ["key", "label", "vector"])


def score(docs: DataFrame, model: Discriminant | float, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability that a document is of class 1, computed where its row is."""
    at_hand = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = at_hand.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if isinstance(model, float):
                scores = np.full(len(texts), model)
            else:
                scores = model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], name])

    others, held = [F.col(c) for c in docs.columns if c != name], free_name(docs, "__text")
    schema = T.StructType([*[docs.schema[c] for c in docs.columns if c != name], T.StructField(name, T.DoubleType())])
    return docs.select(*others, _text(docs, text).alias(held)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Discriminant | float, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score at least `least`."""
    name = free_name(docs, "__score")
    return score(docs, model, text, name).where(F.col(name) >= least).select(*docs.columns)
