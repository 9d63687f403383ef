"""Alignment of two tokenizers against a walk over bytes."""

import pickle
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlens.llm import align, places, queries
from reviewlens.llm.encoder import Encoder
from reviewlens.sources.files import store

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, a int, b int, pairs string, f int, groups string"


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


@pytest.fixture(scope="module")
def ours():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        return align.ByteTokenizer(a.read()), align.PieceTokenizer(b.read())


def texts():
    r = random.Random(3)
    odd = ["a", " ", "  x", "▁x", "a ▁", "<|endoftext|> hi <s> </s> <0x41>", "é漢字\n\t🙂\x00", "​", "a" * 3000, "་ག" * 50]
    pools = ["ab '", "0123 .,!?'s　\u0085", "的 是éß漢", "".join(map(chr, range(0x250))), "ꟍ\U000323b0a1 the of"]
    odd += ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(200))) for _ in range(150)]
    return odd + [" ".join(r.choice(["the", "of", "straße", "tokenizer", "ßé", "12"]) for _ in range(9000)), "der Hund " * 40, "der Hund " * 40]


def by_hand(libraries, text):
    """Ids of both, groups and links, byte by byte."""
    if not text:
        return [], [], [], Counter()
    a, b = libraries
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    back = {c: byte for c, byte in align.bpe.byte_characters().items()}
    spelt_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    spelt_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        spelt_b.append(bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
        return [], [], [], Counter()
    owner_a = [n for n, s in enumerate(spelt_a) for _ in s]
    owner_b = [n for n, s in enumerate(spelt_b) for _ in s]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, cut = [], set(np.cumsum([len(s) for s in spelt_a]).tolist()) & set(np.cumsum([len(s) for s in spelt_b]).tolist())
    start = 0
    for end in sorted(cut):
        part = [
            ",".join(str(ids[n]) for n in dict.fromkeys(owners[start:end])) for ids, owners in ((ids_a, owner_a), (ids_b, owner_b))
        ]
        groups.append("|".join(part))
        start = end
    return ids_a, ids_b, groups, Counter((ids_a[x], ids_b[y]) for x, y in links)


def test_groups_and_links(libraries, ours):
    given = ["", *texts()]
    for text, found in zip(given, align.align_texts(*ours, given)):
        ids_a, ids_b, groups, links = by_hand(libraries, text)
        pairs = Counter({(int(a), int(b)): int(n) for a, b, n in zip(*found["pairs"])})
        assert (found["n_a"], found["n_b"], found["n_groups"]) == (len(ids_a), len(ids_b), len(groups)), text[:40]
        assert found["groups"] == ";".join(groups) and pairs == links and found["n_links"] == sum(links.values())
    assert sum(x["n_a"] == 0 for x in align.align_texts(*ours, given)) >= 3


@pytest.mark.parametrize("seed", range(20))
def test_divided_texts_have_the_same_links(seed):
    r = np.random.default_rng(seed)
    total = 4000
    ends = [np.unique(np.r_[r.integers(1, total, n), total]) for n in (1500, 900)]
    if seed == 0:
        ends = [np.arange(1, 2001) * 2, np.r_[np.arange(2000) * 2 + 1, total]]  # nothing in common but the end
    whole = np.array([[len(ends[0]), len(ends[1])]])
    expected = align.lockstep(*ends, np.zeros((1, 2), int), whole)
    for lane in (1, 7, 100, 10_000):
        stops = np.array(align.divided(*ends, lane))
        assert stops[-1].tolist() == whole[0].tolist()
        found = align.lockstep(*ends, np.r_[np.zeros((1, 2), int), stops[:-1]], stops)
        assert all((x == y).all() for x, y in zip(found, expected))


@pytest.mark.parametrize("limit", [places.MAX_BROADCAST_BYTES, -1])
def test_statistics_of_links(spark, libraries, monkeypatch, limit):
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", limit)
    given = [*enumerate(texts()), (None, None), (7, ""), (7, "a")]
    docs = spark.createDataFrame([(i, t, 1, 2, "p", 3, "g") for i, t in given], SCHEMA).repartition(3)
    hands = [by_hand(libraries, t or "") for _, t in given]
    counts = sum((h[3] for h in hands), Counter())
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    expected = []
    for (i, _), (ids_a, ids_b, groups, links) in zip(given, hands):
        best = sum(n for p, n in links.items() if counts[p] == highest[p[1]])
        expected.append((i, len(ids_a), len(ids_b), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), ";".join(groups)))
    stored = store(align.alignments(docs, *PATHS), "alignments")
    found = align.link_statistics(stored).collect()
    columns = ("doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == sorted(expected, key=str)


def test_an_empty_table(spark):
    stored = store(align.alignments(spark.createDataFrame([], SCHEMA), *PATHS), "alignments")
    assert align.link_statistics(stored).collect() == []


def test_both_ways_of_encoding_agree(ours, libraries, monkeypatch):
    tokenizer = ours[0]
    r = random.Random(5)
    given = texts()
    given += ["".join(r.choice("ab '\n\t\u0085\xa0é0²½!?\x1c\x1fÀ") for _ in range(r.randrange(60))) for _ in range(3000)]
    given += ["".join(chr(r.randrange(0x250)) for _ in range(r.randrange(60))) for _ in range(3000)]
    given += ["x" * 5000 + " y", "'s 'll 'LL it's", "<|endoftext|>"]
    assert tokenizer.encoder._fast is not None
    found = tokenizer.encode(given)
    assert [f.tolist() for f in found[-4000:]] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in given[-4000:]]
    monkeypatch.setattr(tokenizer.encoder, "_fast", None)
    assert all(map(np.array_equal, found, tokenizer.encode(given)))


def test_an_encoder_knows_special_tokens(libraries):
    """They are taken for what they are where the vocabulary has them, also after a journey."""
    vocabulary = queries.vocabulary()
    moved = pickle.loads(pickle.dumps(Encoder(vocabulary)))
    given = ["<|endoftext|>", "a<|endoftext|> b", "plain text", "漢 <|endoftext|>", "", "x" * 3000]
    for encoder in (Encoder(vocabulary), moved):
        assert [ids.tolist() for ids in encoder.encode_arrays(given)] == vocabulary.encode_all(given)
