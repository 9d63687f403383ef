"""The prefix trie against one built by hand."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from reviewlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int, words string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {}
    for c, found in own.items():
        # Of equal numbers the order is that of a digest of role and text.
        def order(t):
            name = f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()
            return (t[0], t[1], hashlib.sha256(name).digest())

        turns[c] = [(t[2], t[3]) for t in sorted(found, key=order)]
    whole = {}
    for c, found in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        whole[c] = turns.get(base, [])[:h] + found[h:]
    return whole


def expected(rows):
    members = defaultdict(list)
    whole = rebuilt(rows)
    for c, found in whole.items():
        for d in range(len(found) + 1):
            members[tuple(found[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in children[path])
    result = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves[path], saved[path], digest))
    return sorted(result, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*row, "n", 9, "w") for row in rows], SCHEMA).repartition(partitions)
    found = trie.prefix_trie(docs)
    assert found.columns == list(COLUMNS)
    assert sorted(map(tuple, found.collect()), key=str) == expected(rows)


@pytest.fixture
def small_batches(spark, monkeypatch):
    options = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in options.items():
        spark.conf.set(name, value)
    yield
    for name in options:
        spark.conf.unset(name)


def some(r, n, longest, kinds):
    rows = []
    for c in range(n):
        if r.random() < 0.9:
            text = [("user" if t % 2 else "system", f"w{r.randrange(kinds)} " * r.randrange(1, 4)) for t in range(r.randrange(1, longest))]
            rows += [(c, t, *x) for t, x in enumerate(text)]
    return rows


def test_random_conversations(spark):
    check(spark, some(random.Random(1), 200, 9, 2))


def test_copies_long_conversations_and_batches(spark, small_batches):
    """Many copies of one conversation, one of very many turns and one of it that goes on otherwise."""
    r = random.Random(2)
    rows = some(r, 40, 6, 2)
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(4)]
    rows += [(400, t, "user", f"word {t % 7}") for t in range(133)] + [(420, t, "user", f"word {t % 7 + t // 100}") for t in range(129)]
    r.shuffle(rows)
    check(spark, rows, 4)


def test_nulls_ties_and_missing_turns(spark):
    rows = [(20, None, None, None), (20, None, "", "x"), (20, 1, "user", None), (20, 1, "user", "a b"), (20, 1, "user", "a b")]
    rows += [(c, t, "user", "hello") for c in (21, 22, 23, 24, 25, 26, 27, 28) for t in range(c % 3 + 1)]
    rows += [(c, 0, "a", "one") for c in range(41, 60)] + [(None, 0, "user", "no conversation"), (-3, 1, "x", "y"), (-20, 1, "x", "z")]
    check(spark, rows)


def test_roles_and_texts_are_told_apart(spark):
    check(spark, [(0, 0, "ab", "c"), (20, 0, "a", "bc"), (40, 0, "", "abc"), (60, 0, "ab", "c")])


def test_an_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "a", "b", "n", 1, "w")], SCHEMA)
    assert trie.prefix_trie(nobody).collect() == []
