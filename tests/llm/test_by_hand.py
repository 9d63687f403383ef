"""Language mixtures, phrase names and the discriminant against plain versions of their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewlens.llm import bpe, language, parsing, quality, queries, repeats

MASK = (1 << 64) - 1


# Languages: trigrams counted in dictionaries, expectation-maximisation in lists.


def bucket(a, b, c):
    return ((a | b << 8 | c << 16) * 2654435761 % (1 << 32)) >> 16


def grams(text):
    codes = b" " + text.lower().encode() + b" "
    return [bucket(*codes[i : i + 3]) for i in range(len(codes) - 2)]


class SlowModel:
    def __init__(self, rows):
        counts = defaultdict(Counter)
        for text, lang in rows:
            if lang is not None and any(c.isalpha() for c in text or ""):
                counts[lang].update(grams(text))
        self.languages = sorted(counts)
        total = {lang: sum(counts[lang].values()) + language.SMOOTHING * language.BUCKETS for lang in counts}
        self.p = lambda g, lang: (counts[lang][g] + language.SMOOTHING) / total[lang]

    def shares(self, found, languages):
        share = [1 / len(languages)] * len(languages)
        total = sum(found.values())
        for _ in range(language.ROUNDS):
            new = [0.0] * len(languages)
            for g, n in found.items():
                parts = [s * self.p(g, lang) for s, lang in zip(share, languages)]
                for i, part in enumerate(parts):
                    new[i] += n * part / sum(parts) / total
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
            share = new
            if done:
                break
        return [s / sum(share) for s in share]

    def identify(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        found = Counter(grams(text))
        n = sum(found.values()) / language.OVERLAP

        def likelihood(share, languages):
            each = (sum(s * self.p(g, lang) for s, lang in zip(share, languages)) for g in found)
            return sum(k * math.log(p) for k, p in zip(found.values(), each)) / language.OVERLAP

        alone = {lang: likelihood([1.0], [lang]) for lang in self.languages}
        chosen = [max(self.languages, key=alone.get)]
        share, best = [1.0], alone[chosen[0]]
        together = dict(zip(self.languages, self.shares(found, self.languages)))
        for lang in sorted((x for x in self.languages if x not in chosen), key=lambda x: -together[x]):
            grown = [*chosen, lang]
            tried = self.shares(found, grown)
            reached = likelihood(tried, grown)
            if reached - best <= 0.5 * math.log(max(n, 2)):
                break
            chosen, share, best = grown, tried, reached
        return min(zip([-s for s in share], chosen))[1], max(share)


def test_language_by_hand(spark):
    r = random.Random(3)
    letters = {"aa": "abcdelmo ", "bb": "krstuvxyz ", "cc": "éèçaeiou nst"}
    made = [("".join(r.choice(letters[k]) for _ in range(r.randint(20, 300))), k) for k in letters for _ in range(25)]
    made += [("123 456", "dd"), ("no language", None)]
    model = language.fit(spark.createDataFrame(made, "text string, lang string"))
    slow = SlowModel(made)
    assert model.languages == slow.languages
    texts = ["".join(r.choice(letters[k]) for k in r.choices("aa bb cc".split(), weights, k=200)) for weights in ((1, 0, 0), (0, 1, 2))]
    texts += [made[0][0][:90] + " " + made[30][0][:60] + " " + made[60][0][:30] for _ in range(3)]
    texts += ["", "12", None, "a", "ÉÈ", "k" * 2000] + [text for text, _ in made[:75:9]]
    for text in texts:
        found = model.identify(text and text.encode())
        pred, share = slow.identify(text)
        assert found[0] == pred and found[1] == pytest.approx(share, abs=2e-3), text


def test_language_of_a_very_long_text(spark):
    rows = [("alpha beta gamma " * 50, "x"), ("един два три " * 50, "y")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    text = ("alpha gamma beta " * 60_000 + "три два " * 40_000).encode()
    assert len(text) > 1 << 20
    pred, share, _ = model.identify(text)
    assert pred == "x" and 0.5 < share < 0.8


# Phrases: one text at a time, a symbol at a time.


def mix(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & MASK
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def lowest_bit(x):
    return (x & -x).bit_length() - 1


def toss(before, own):
    """Where two numbers first differ, and what the second has there."""
    place = lowest_bit(before ^ own)
    return 2 * place + (own >> place & 1)


def phrases(names, level):
    runs = []
    for name in names:
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1])
    names = [(name + (n - 1) * 0x9E3779B97F4A7C15) & MASK for name, n in runs] if any(n > 1 for _, n in runs) else list(names)
    labels = [toss(names[i - 1], names[i]) if i else 0 + (names[0] & 1) for i in range(len(names))]
    for _ in range(3):
        labels = [toss(labels[i - 1] if i else labels[0] ^ 1, label) for i, label in enumerate(labels)]
    starts = [0] + [i for i in range(1, len(names) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    result = []
    for a, b in zip(starts, [*starts[1:], len(names)]):
        total = sum(mix((name + (place + 1) * 0xD1B54A32D192ED03) & MASK) for place, name in enumerate(names[a:b]))
        result.append(mix((total + level) & MASK))
    return result


def slow_fingerprint(text):
    if not text:
        return ":"
    names, levels = [b + 1 for b in text], []
    while True:
        names = phrases(names, len(levels) + 1)
        levels.append(names)
        if len(names) == 1:
            break

    def smallest(several):
        found = sorted({name >> 32 for names in several for name in names})[: parsing.KEPT]
        return "".join(f"{name:08x}" for name in found)

    long_names = smallest(levels[parsing.LONG_FROM - 1 :])
    short_names = smallest(levels[: parsing.LONG_FROM - 1]) if len(long_names) < 8 * parsing.FEW else ""
    return f"{long_names}:{short_names}"


def texts_to_parse():
    r = random.Random(8)
    texts = [b"", b"a", b"ab", b"aa", b"aaaa", b"abab" * 9, bytes(range(256)), bytes(range(256)) * 3, b"\x00" * 70, "é漢".encode() * 20]
    texts += [bytes(r.choice(b"ab") for _ in range(r.randrange(200))) for _ in range(60)]
    texts += [bytes(r.choice(b"abcdefgh ijkl") for _ in range(r.randrange(2000))) for _ in range(30)]
    return texts + [bytes(r.randrange(256) for _ in range(3000)), b"the same words again " * 300]


def test_fingerprints_by_hand():
    texts = texts_to_parse()
    assert parsing.fingerprints(texts) == [slow_fingerprint(t) for t in texts]
    assert [parsing.fingerprints([t])[0] for t in texts] == parsing.fingerprints(texts)


def test_fingerprints_of_long_texts_and_their_likeness():
    r = random.Random(9)
    words = [bytes(r.choice(b"abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    body = b" ".join(r.choice(words) for _ in range(220_000))
    assert len(body) > 1 << 20
    moved = b"xyz" + body
    half = body[: len(body) // 2] + b" ".join(r.choice(words) for _ in range(110_000))
    prints = parsing.fingerprints([body, moved, half])
    assert prints[0] == slow_fingerprint(body)
    assert parsing.likeness(prints[0], prints[1]) > 0.9
    assert 0.1 < parsing.likeness(prints[0], prints[2]) < 0.7  # a third of all phrases are in both


# The discriminant: densities by the formula, with inverses and determinants.


def slow_features(text):
    n = len(text)
    if not n:
        return [0.0] * quality.FEATURES
    kinds = {name: sum(text.count(bytes([b])) for b in members) for name, members in quality._CLASSES.items()}
    words = text.split()
    w, log = max(1, len(words)), math.log
    chances = [text.count(bytes([b])) / n for b in set(text)]
    return [
        log(1 + n),
        log(0.01 + kinds["upper"] / max(1, kinds["upper"] + kinds["lower"])),
        *[log(0.01 + kinds[k] / n) for k in ("symbol", "bang", "bar", "digit")],
        log(0.01 + kinds["stop"] / w),
        log(0.01 + kinds["line"] / w),
        log(0.01 + sum(a == b for a, b in zip(words, words[1:])) / (w + 8)),
        log(max(1, len(set(words)))) / log(w + 1),
        log(1 + sum(map(len, words)) / w),
        kinds["space"] / n,
        sum(b >= 128 for b in text) / n,
        -sum(p * log(p) for p in chances),
    ]


def slow_covariance(rows):
    n, d = len(rows), len(rows[0])
    mean = [sum(r[i] for r in rows) / n for i in range(d)]
    return np.array([[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / (n - 1) for j in range(d)] for i in range(d)])


def slow_scores(rows, labels, prior, shrink, asked):
    """Probability of class 1 from two normal densities, in units of each statistic's deviation."""
    scale = np.std(rows, axis=0) + 1e-6
    rows, asked = np.array(rows) / scale, np.array(asked) / scale
    own = [slow_covariance(rows[labels == c].tolist()) for c in (0, 1)]
    sizes = [int((labels == c).sum()) for c in (0, 1)]
    pooled = (own[0] * sizes[0] + own[1] * sizes[1]) / sum(sizes)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    logs = []
    for c, p in ((0, 1 - prior), (1, prior)):
        matrix = (1 - shrink) * own[c] + shrink * pooled + 1e-3 * np.eye(len(pooled))
        away = asked - rows[labels == c].mean(0)
        distance = np.einsum("ni,ij,nj->n", away, np.linalg.inv(matrix), away)
        logs.append(math.log(p) - 0.5 * np.linalg.slogdet(matrix)[1] - 0.5 * distance)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def labelled(n, seed):
    r = random.Random(seed)
    found = []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 60))]
        text = " ".join(words) + r.choice([".", "", "\n"])
        if not good:
            text = r.choice([text.upper() + "!!", "buy buy " * r.randint(1, 9) + text, "| 1 | 2 |" * 3 + text])
        found.append((text.encode(), int(good)))
    return found


def test_statistics_by_hand():
    for text, _ in [*labelled(60, 1), (b"", 0), (b" ", 0), ("É漢 ".encode() * 9, 0), (b"A" * (1 << 20), 0)]:
        assert quality.features(text) == pytest.approx(slow_features(text))


def test_discriminant_by_hand():
    rows = labelled(150, 2)
    vectors, labels = np.array([quality.features(t) for t, _ in rows]), np.array([q for _, q in rows])
    asked = np.array([quality.features(t) for t, _ in labelled(40, 3)])

    def scores(shrink, training, given, chosen):
        return slow_scores(training, given, 0.6, shrink, chosen)

    for shrink in (0.05, 0.4, 1.0):
        model = quality.Discriminant._fit(vectors, labels, 0.6, shrink)
        assert model.score(asked) == pytest.approx(scores(shrink, vectors, labels, asked), abs=1e-9)

    # The share is that with the least loss on four folds, a class's vectors dealt out in turn.
    turn = np.empty(len(labels), int)
    for c in (0, 1):
        turn[labels == c] = [i % 4 for i in range((labels == c).sum())]

    def loss(shrink):
        total = 0
        for fold in range(4):
            found = scores(shrink, vectors[turn != fold], labels[turn != fold], vectors[turn == fold])
            total -= sum(math.log(max(p if q else 1 - p, 1e-12)) for p, q in zip(found, labels[turn == fold]))
        return total

    best = min(quality.SHRINK_TO_POOLED, key=loss)
    model = quality.Discriminant.fit(vectors, labels, 0.6)
    assert model.score(asked) == pytest.approx(scores(best, vectors, labels, asked), abs=1e-9)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, t.decode(), q) for i, (t, q) in enumerate(labelled(90, 4))]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    tables = [spark.createDataFrame([r[:2] for r in part], "doc_id long, text string") for part in (rows, rows[::-1])]
    models = [quality.fit(t.repartition(n), labels) for t, n in zip(tables, (1, 5))]
    found = [sorted(map(tuple, quality.score(tables[0], m).select("doc_id", "score").collect())) for m in models]
    assert found[0] == found[1]


def test_documents_that_share_an_identifier_teach_once(spark):
    rows = [(i, t.decode()) for i, (t, _) in enumerate(labelled(90, 5))]
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(labelled(90, 5))], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = quality.fit(spark.createDataFrame(rows + rows[:30] * 40, "doc_id long, text string"), labels)
    assert np.allclose(once.means, often.means) and np.allclose(once.whiten, often.whiten)


# Long texts and what a worker remembers.


def test_the_encoder_forgets_and_learns_again(monkeypatch):
    vocabulary = bpe.load(queries.vocabulary_path())
    fresh = [f"word{i} straße{i}x" for i in range(300)]
    expected = vocabulary.encode_all(fresh)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 40)
    small = bpe.load(queries.vocabulary_path())
    for _ in range(3):
        assert [small.encode_all(fresh[i : i + 7]) for i in range(0, 300, 7)] == [expected[i : i + 7] for i in range(0, 300, 7)]
    assert len(small._known) < 100 and len(small._before) < 100


def test_repeats_across_the_stretches_of_long_texts(spark):
    """Two texts of over a megabyte that share strings where the parts they are read in meet."""
    r = random.Random(10)
    one, other = (bytearray(r.choice(b"abcdefghijklmnop") for _ in range(1_100_000)) for _ in range(2))
    for at, size in ((repeats.STRETCH - 300, 900), (2 * repeats.STRETCH - 150, 200), (5, 199), (900_000, 5000)):
        other[at : at + size] = one[at : at + size]
    rows = [(1, one.decode()), (2, other.decode()), (3, "short")]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] or ()] for r in found}

    def shared(a, b):
        """Maximal equal stretches at the same places, as texts of random letters repeat nowhere else."""
        same = np.frombuffer(bytes(a), np.uint8) == np.frombuffer(bytes(b), np.uint8)
        edges = np.flatnonzero(np.diff(np.r_[0, same.astype(int), 0]))
        return [(x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()) if y - x >= repeats.LENGTH]

    assert spans == {1: shared(one, other), 2: shared(one, other), 3: []} and len(spans[1]) == 3
