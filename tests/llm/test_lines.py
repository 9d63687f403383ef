"""Line dedup against a brute-force version."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import lines, places

SCHEMA = "doc_id long, text string, keep int, line string, __at int, __row string"
WHITE = " \t\n\x0b\x0c\r"


def expected(rows, least_characters=40, least_documents=5):
    """By row: identifier, lines, dropped lines, kept text. Rows are in the order they are stored."""
    holders = defaultdict(set)
    texts = [(text or "").split("\n") for _, text in rows]

    def key(line):
        line = line.strip(WHITE)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    for n, text in enumerate(texts):
        for line in text:
            if len(key(line)) >= least_characters:
                holders[key(line)].add(n)
    rank = [(i is not None, i if i is not None else 0, n) for n, (i, _) in enumerate(rows)]
    keeper = {k: max(ns, key=rank.__getitem__) for k, ns in holders.items() if len(ns) >= least_documents}
    found = []
    for n, ((i, _), text) in enumerate(zip(rows, texts)):
        kept = [line for line in text if keeper.get(key(line), n) == n]
        found.append((i, len(text), len(text) - len(kept), "\n".join(kept)))
    return sorted(found, key=str)


def some_rows(r, n=300):
    common = ["the same line in very many documents, " + c * 20 for c in "abcdefgh"]
    common += ["É" * 39 + "x", "é" * 39, "Ünd so weiter " * 4, "MIXED case LINE that " * 3]
    rows = []
    for i in range(n):
        text = ["only here " + "".join(r.choice("xyz") for _ in range(50)) for _ in range(r.randrange(3))]
        text += [r.choice(common[: 1 + r.randrange(12)]) for _ in range(r.randrange(4))]
        if i % 3:
            text.append(common[0])
        text = [r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", "\r", " \x0b"]) for x in text]
        r.shuffle(text)
        rows.append((i * 7 % n, "\n".join(text)))
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, "\n\n"), (n + 4, common[0] + "\n" + common[0]), (n + 5, "a\n" * 70_000 + common[1])]


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], bytes(r["kept"]).decode()) for r in df.collect()), key=str)


@pytest.fixture
def small_batches(spark):
    """Keys and documents that begin and end in the middle of batches and tasks."""
    options = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in options.items():
        spark.conf.set(name, value)
    yield
    for name in options:
        spark.conf.unset(name)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("limit", [places.MAX_BROADCAST_BYTES, -1])
def test_lines_are_dropped_as_by_hand(spark, small_batches, monkeypatch, limit):
    monkeypatch.setattr(places, "MAX_BROADCAST_BYTES", limit)
    rows = some_rows(random.Random(1))
    assert found(lines.drop_repeated_lines(frame(spark, rows).repartition(3))) == expected(rows)


@pytest.mark.parametrize("seed", range(4))
def test_a_key_over_many_tasks(spark, small_batches, seed):
    """One line in nearly all documents, others in just as many as it takes or one less."""
    r = random.Random(seed)
    rows = [(i, "l" * 45 + "\n" + "m" * 45 if i % 9 else "n" * 45) for i in range(120)]
    rows += [(1000 + i, "k" * 40 + str(i % 24)) for i in range(24 * 4 + 6)]
    r.shuffle(rows)
    assert found(lines.drop_repeated_lines(frame(spark, rows).repartition(5))) == expected(rows)


def test_few_documents_and_short_keys(spark):
    rows = [(i, "ab\ncde \n" + "x" * i) for i in range(4)]
    docs = frame(spark, rows)
    assert found(lines.drop_repeated_lines(docs)) == expected(rows)
    assert found(lines.drop_repeated_lines(docs, least_characters=2, least_documents=2)) == expected(rows, 2, 2)


def test_identifiers_null_repeated_or_text(spark):
    line = "w" * 50
    rows = [(None, line), (None, line), (3, line), (3, line + "\nb"), (2, line)]
    kept = lines.drop_repeated_lines(frame(spark, rows)).collect()
    assert sum(line.encode() in r["kept"] for r in kept) == 1
    assert next(r["doc_id"] for r in kept if line.encode() in r["kept"]) == 3
    named = frame(spark, [(i, line) for i in range(6)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert [r["doc_id"] for r in lines.drop_repeated_lines(named).collect() if r["kept"]] == ["d5"]


def test_bitmaps(spark):
    rows = some_rows(random.Random(2), 60)
    marks = lines.keep_bitmaps(frame(spark, rows)).collect()
    by_id = {i: (n, lost) for i, n, lost, _ in expected(rows)}
    for row in marks:
        keep = lines.unpack_bitmap(bytes(row["keep"]), row["n_lines"])
        assert (row["n_lines"], row["n_dropped"]) == by_id[row["doc_id"]] == (len(keep), int((~keep).sum()))
    longest = max(marks, key=lambda r: r["n_lines"])
    assert longest["n_lines"] > 70_000 and len(longest["keep"]) < 200
    bits = np.random.default_rng(1).integers(0, 2, 77).astype(bool)
    assert (lines.unpack_bitmap(lines.pack_bitmap(np.flatnonzero(~bits).tolist(), 77), 77) == bits).all()
    assert len(zlib.decompress(lines.pack_bitmap([], 9))) == 2


def test_an_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert lines.drop_repeated_lines(nothing).collect() == []
    assert lines.keep_bitmaps(nothing).collect() == []


def test_line_key():
    assert lines.line_key(" \tÀB c\r".encode()) == "Àb c".encode()
