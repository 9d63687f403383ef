"""The text functions of this package for SQL: temporary functions of a session, each an expression that
Spark puts in place of its call, so that a query in SQL is planned as the same query in Python is."""

from __future__ import annotations

from pyspark.sql import SparkSession

from reviewlens.functions.text import CENSORED, FILE_NAME, LINE_BREAK, NUMBER, PUNCTUATION, WHITESPACE


def _literal(text: str) -> str:
    """`text` in SQL, whatever quotes and backslashes it holds."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """The body of each function, by its head."""
    spaced = f"replace(t, {_literal(LINE_BREAK)}, ' ')"
    censored = f"endswith(w, '*') AND rlike(w, {_literal(CENSORED)})"
    before, after = map(_literal, FILE_NAME)
    return {
        "review_text(t STRING) RETURNS STRING": (
            f"lower(regexp_replace(regexp_replace({spaced}, {_literal(WHITESPACE)}, ' '), {_literal(PUNCTUATION)}, ''))"
        ),
        "review_words(t STRING) RETURNS ARRAY<STRING>": (
            f"array_remove(split(lower(regexp_replace({spaced}, {_literal(PUNCTUATION)}, '')), {_literal(WHITESPACE)}), '')"
        ),
        "is_censored_word(w STRING) RETURNS BOOLEAN": censored,
        "is_number_word(w STRING) RETURNS BOOLEAN": f"rlike(w, {_literal(NUMBER)})",
        "is_telling_word(w STRING) RETURNS BOOLEAN": (
            f"((w >= 'a' AND w < '{{') OR (w >= '0' AND w < ':')) AND length(w) <> 1 AND NOT ({censored})"
        ),
        "category_spelling(c STRING) RETURNS STRING": "trim(regexp_replace(c, '[_& ]+', ' '))",
        "category_of_file(name STRING, marketplace STRING) RETURNS STRING": (
            f"nullif(replace(regexp_extract(name, concat({before}, marketplace, {after}), 1), '_', ' '), '')"
        ),
    }


def register(spark: SparkSession) -> None:
    """Makes the functions known to `spark.sql` in this session."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
