"""Text cleaning, words and word filters, as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words. Java's own \s is ASCII only, and its Unicode form leaves out
# U+001C to U+001F. Spelling the Unicode spaces out instead triples the time of a split.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# The line break tag and the characters dropped wherever they stand.
LINE_BREAK = "<br />"
PUNCTUATION = "[,.!?']+"

# A word that is blotted out, and one that is a number.
CENSORED = r"^[a-z]\*+$"
NUMBER = "^[0-9]+$"


def clean_text(text: Column) -> Column:
    """Lower-case text without line break tags, `, . ! ?` or apostrophes, any whitespace one space."""
    text = F.replace(text, F.lit(LINE_BREAK), F.lit(" "))
    text = F.regexp_replace(text, WHITESPACE, " ")
    return F.lower(F.regexp_replace(text, PUNCTUATION, ""))


def words(text: Column) -> Column:
    """The words of `clean_text` as an array, split without that pass over its whitespace. It holds
    '' where the text starts or ends in whitespace; `explode_words` and `count_words` leave that out."""
    text = F.replace(text, F.lit(LINE_BREAK), F.lit(" "))
    return F.split(F.lower(F.regexp_replace(text, PUNCTUATION, "")), WHITESPACE)


def explode_words(df: DataFrame, text: str, word: str = "word") -> DataFrame:
    """One row per word occurrence, with every other column of `df`. A null text gives no row."""
    others = [F.col(c) for c in df.columns if c != text]
    return df.select(*others, F.explode(words(F.col(text))).alias(word)).where(F.col(word) != "")


def clean_word(word: str) -> str:
    """A word spelt as `clean_text` leaves it."""
    return re.sub(PUNCTUATION, "", word).lower()


def count_words(text: Column) -> Column:
    """How many words a text holds; null for a null text."""
    return F.size(F.array_remove(words(text), "")).cast("bigint")


def starts_alphanumeric(word: Column) -> Column:
    """The first character is a to z or 0 to 9. Compared as bytes: '{' follows 'z', ':' follows '9'."""
    return ((word >= "a") & (word < "{")) | ((word >= "0") & (word < ":"))


def is_censored(word: Column) -> Column:
    """One letter followed by nothing but asterisks."""
    return word.endswith("*") & word.rlike(CENSORED)


def is_number(word: Column) -> Column:
    """Digits only."""
    return word.rlike(NUMBER)


def is_telling(word: Column, drop_numbers: bool = False) -> Column:
    """Words worth reporting, stop words apart."""
    keep = starts_alphanumeric(word) & (F.length(word) != 1) & ~is_censored(word)
    return keep & ~is_number(word) if drop_numbers else keep


def without_stop_words(df: DataFrame, stop_words: Iterable[str] | DataFrame | None, word: str = "word") -> DataFrame:
    """Rows of `df` whose word is no stop word.

    A Python list is compiled into the filter; a DataFrame (its first column, which may repeat a
    word) is anti-joined, and Spark broadcasts it if its size allows.
    """
    if stop_words is None:
        return df
    if isinstance(stop_words, DataFrame):
        listed = stop_words.select(F.col(stop_words.columns[0]).alias(word)).distinct()
        return df.join(listed, word, "left_anti")
    listed = sorted({clean_word(w) for w in stop_words})
    return df.where(~F.col(word).isin(listed)) if listed else df


def default_stop_words() -> list[str]:
    """Spark's English stop words, spelled as `clean_text` leaves them. Needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w.replace("'", "").lower() for w in StopWordsRemover.loadDefaultStopWords("english")})


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """A stop list of one word per line, spelled as `clean_text` leaves them."""
    lines = spark.read.text(path)
    return lines.select(F.trim(clean_text(F.col("value"))).alias("word")).where("word <> ''")


def normalise_category(category: Column) -> Column:
    """One spelling for categories from columns and file names: spaces, no `_` and no `&`."""
    return F.trim(F.regexp_replace(category, "[_& ]+", " "))


# The name of a review file, before and after its marketplace.
FILE_NAME = (r"^[a-z]+_reviews_", r"_(.+)_v\d+_\d+\.tsv\.gz$")


def category_from_file_name(name: Column, marketplace: str = "us") -> Column:
    """`Home Improvement` for `<dataset>_reviews_us_Home_Improvement_v1_00.tsv.gz`.

    Null for a file of another marketplace or another naming.
    """
    found = F.regexp_extract(name, marketplace.join(FILE_NAME), 1)
    return F.nullif(F.replace(found, F.lit("_"), F.lit(" ")), F.lit(""))
