import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text

# Text, and its words after cleaning and filtering without a stop list.
CASES = [
    ("It's  GREAT!<br />Don't... buy", ["its", "great", "dont", "buy"]),
    ('a b tab\tx f*** f**k 4-7 rinse" -dash (paren) x', ["tab", "f**k", "4-7", 'rinse"']),
    ("   ", []),
    ("<BR />upper . , !", []),
    ("café İstanbul ΣΣ wait ... ok--but", ["café", "i̇stanbul", "wait", "ok--but"]),
    ("three\x1cfour\x85five", ["three", "four", "five"]),
    ("one\u2003two\xa0three\u3000four\u2028five", ["one", "two", "three", "four", "five"]),
    ("a.b 10 x1 9*** 5", ["ab", "10", "x1", "9***"]),
    ("<br /><br />start end<br />", ["start", "end"]),
    ("", []),
    (None, []),
]


def python_words(value):
    """The words of a text, by Python's own idea of whitespace."""
    kept = "".join(c for c in value.replace("<br />", " ") if c not in ",.!?'")
    return kept.lower().split()


def python_telling(word):
    return bool(re.match("[a-z0-9]", word)) and len(word) != 1 and not re.fullmatch(r"[a-z]\*+", word)


def test_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, body string")
    found = text.explode_words(rows, "body").where(text.is_telling(F.col("word")))
    words = {}
    for row in found.collect():
        words.setdefault(row["id"], []).append(row["word"])
    for i, (_, expected) in enumerate(CASES):
        assert words.get(i, []) == expected


def test_numbers_are_dropped_on_request(spark):
    words = spark.createDataFrame([("10",), ("1x",), ("x1",), ("٣٣",)], "w string")
    kept = words.where(text.is_telling(F.col("w"), drop_numbers=True)).collect()
    assert {r["w"] for r in kept} == {"1x", "x1"}


def test_random_texts_against_python(spark):
    rng = random.Random(7)
    pieces = list("abzZé09*'.,!?-\"{:;/`") + ["<br />", "<br/>", "\t", "\n", "\r", "\x0b", "\x0c", "\x1f", "\x85"]
    pieces += ["\u1680", "\u2009", "\u202f", "\u205f", " ", " ", " ", "\u200b", "İ", "ß", "日本"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    found = text.explode_words(rows, "body").withColumn("telling", text.is_telling(F.col("word")))
    got, got_telling = [[] for _ in texts], [[] for _ in texts]
    for row in found.collect():
        got[row["id"]].append(row["word"])
        if row["telling"]:
            got_telling[row["id"]].append(row["word"])
    counts = {r["id"]: r["n"] for r in rows.select("id", text.count_words(F.col("body")).alias("n")).collect()}
    clean = {r["id"]: r["c"] for r in rows.select("id", text.clean_text(F.col("body")).alias("c")).collect()}
    for i, value in enumerate(texts):
        assert got[i] == python_words(value) == clean[i].split()
        assert got_telling[i] == [w for w in got[i] if python_telling(w)]
        assert counts[i] == len(got[i])


def test_whitespace_is_all_that_python_splits_on(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and i != 0]
    spaces = {c for c in every if c.isspace()}
    rows = spark.createDataFrame([(f"x{c}x",) for c in every], "body string")
    split = rows.where(F.size(F.split("body", text.WHITESPACE)) == 2).collect()
    assert {r["body"][1:-1] for r in split} == spaces


@pytest.mark.parametrize("as_table", [False, True])
def test_stop_words(spark, as_table):
    words = spark.createDataFrame([("the",), ("bag",), ("the",), ("dont",)], "word string")
    stop = ["the", "dont"]
    listed = spark.createDataFrame([(w,) for w in stop], "w string") if as_table else stop
    assert [r["word"] for r in text.without_stop_words(words, listed).collect()] == ["bag"]


def test_no_stop_words(spark):
    words = spark.createDataFrame([("the",)], "word string")
    assert text.without_stop_words(words, None).count() == text.without_stop_words(words, []).count() == 1


def test_stop_lists_are_spelt_as_words_are(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("The\n  don't \n\nof\n...\n")
    assert {r["word"] for r in text.read_stop_words(spark, str(path)).collect()} == {"the", "dont", "of"}
    default = text.default_stop_words()
    assert "the" in default and "dont" in default and not any("'" in w for w in default)


def test_category_spelling(spark):
    rows = [("Health_&_Personal_Care",), ("Health Personal Care",), ("Home_Improvement",), (" PC ",)]
    got = spark.createDataFrame(rows, "c string").select(text.normalise_category(F.col("c")).alias("c")).collect()
    assert [r["c"] for r in got] == ["Health Personal Care", "Health Personal Care", "Home Improvement", "PC"]


def test_category_from_file_name(spark):
    rows = [
        ("data_reviews_us_Home_Improvement_v1_00.tsv.gz", "Home Improvement"),
        ("data_reviews_us_Digital_Ebook_Purchase_v1_01.tsv.gz", "Digital Ebook Purchase"),
        ("data_reviews_us_PC_v1_00.tsv.gz", "PC"),
        ("data_reviews_de_PC_v1_00.tsv.gz", None),
        ("index.txt", None),
    ]
    df = spark.createDataFrame(rows, "name string, expected string")
    for row in df.withColumn("got", text.category_from_file_name(F.col("name"))).collect():
        assert row["got"] == row["expected"]
