"""The corpus queries, each an operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import (
    align,
    bpe,
    exact,
    language,
    lines,
    mixing,
    packing,
    parsing,
    quality,
    repeats,
    simhash,
    trie,
    urls,
)
from reviewlens.sources.files import store

# The rules of op8, longest names win.
RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]
ROW_LENGTH = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def vocabulary_path() -> str:
    """The tokenizer the queries use; on a cluster the driver alone reads it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _vocabulary(path: str) -> bpe.Vocabulary:
    return bpe.load(path)


def vocabulary() -> bpe.Vocabulary:
    return _vocabulary(vocabulary_path())


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = _documents(spark, folder)
    held_out = language.fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return packing.pack(_documents(spark, folder), vocabulary(), ROW_LENGTH)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and the component it is linked into."""
    return simhash.near_duplicates(_documents(spark, folder))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return parsing.edited_likeness(_documents(spark, folder))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    encoded = bpe.encode(_documents(spark, folder), vocabulary(), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mixed by weights 5, 2, 1 to 150 % of all words, none above twice its own."""
    mixed = mixing.copies(_documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score, learned from two of three folds."""
    docs = _documents(spark, folder)
    model = quality.fit(docs, _table(spark, folder, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.judge(_table(spark, folder, "pages"), RULES)


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to strings of 200 bytes that stand elsewhere too."""
    cleaned = repeats.remove_repeats(_documents(spark, folder))
    n_bytes = F.octet_length("text").cast("bigint")
    return cleaned.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one of its group of equal texts that stays."""
    return exact.exact_duplicates(_documents(spark, folder))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by two tokenizers, their groups and links. What is stored between the two
    passes holds the digest of the groups in place of the groups."""
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = align.alignments(_documents(spark, folder), *paths)
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    counts = ("n_a", "n_b", "n_groups", "n_links")
    stored = store(aligned.select("doc_id", "f", "row", *counts, groups, "pairs"), "alignments")
    return align.link_statistics(stored).select("doc_id", *counts, "n_best", "count_sum", "groups_sha256")


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document keeps without the lines that others hold too."""
    kept = lines.drop_repeated_lines(_documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_repeats": op9_repeats,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_alignment": op11_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op6_mixing": r"""
        WITH sizes AS (
          SELECT doc_id, source,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
          FROM documents),
        sources AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                 [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
          FROM sizes GROUP BY source),
        steps AS (
          SELECT cap / weight AS up_to, sum(cap) AS given, sum(weight) AS taken FROM sources GROUP BY cap / weight
          UNION ALL SELECT -1, 0, 0),
        levels AS (
          SELECT up_to, lead(up_to) OVER (ORDER BY up_to) AS next_step,
                 (1.5::DOUBLE * (SELECT sum(size) FROM sizes) - sum(given) OVER (ORDER BY up_to))
                 / ((SELECT sum(weight) FROM sources) - sum(taken) OVER (ORDER BY up_to)) AS level
          FROM steps),
        chosen AS (
          SELECT min(level) AS level FROM levels
          WHERE level >= up_to AND (next_step IS NULL OR level < next_step) AND isfinite(level)),
        rates AS (
          SELECT source, source_size, least(cap, coalesce((SELECT level FROM chosen), 0) * weight) AS target,
                 CAST('0x' || substr(md5('0' || CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END), 1, 13)
                      AS BIGINT) / 4503599627370496.0::DOUBLE AS start
          FROM sources),
        placed AS (
          SELECT doc_id, size, s.source, source_size, target, start,
                 CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 row_number() OVER (PARTITION BY s.source
                   ORDER BY size, CASE WHEN doc_id IS NULL THEN -1 ELSE (doc_id % 256 + 256) % 256 END, doc_id) AS place
          FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target,
               CAST((floor(place * rate + start) - floor((place - 1) * rate + start)) * size AS BIGINT) AS taken
        FROM placed""",
    "op8_url_filter": r"""
        WITH parts AS (
          SELECT page_id,
                 CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        split AS (
          SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
          FROM parts),
        hosts AS (
          SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
        named AS (
          SELECT *, '.' || host AS dotted FROM hosts),
        ruled AS (
          SELECT page_id, host, path,
                 CASE WHEN dotted LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                      WHEN dotted LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                      WHEN dotted LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                      WHEN dotted LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                      WHEN dotted LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
          FROM named)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op10_exact_dedup": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY body)""",
    "op12_line_dedup": r"""
        WITH numbered AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        keyed AS (
          SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM numbered),
        common AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (
          SELECT doc_id, line, pos, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op13_prefix_trie": r"""
        WITH own AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (
          SELECT conv_id, list_reduce(
                   list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                                   lambda c: [256 + ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda x, y: CASE WHEN y >= 0 THEN xor(x, (y - 256)::BIGINT)
                                     WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END) AS state
          FROM (SELECT DISTINCT conv_id FROM own)),
        lent AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(state, 4294967295::BIGINT) % 4 AS h FROM bits),
        joined AS (
          SELECT l.conv_id, 0 AS part, o.pos, o.role, o.text FROM lent l JOIN own o ON o.conv_id = l.base AND o.pos < l.h
          UNION ALL
          SELECT l.conv_id, 1, o.pos, o.role, o.text FROM lent l JOIN own o ON o.conv_id = l.conv_id AND o.pos >= l.h),
        whole AS (
          SELECT conv_id, list(role || chr(0) || text ORDER BY part, pos) AS turns FROM joined GROUP BY conv_id),
        rebuilt AS (SELECT conv_id, coalesce(turns, []) AS turns FROM lent LEFT JOIN whole USING (conv_id)),
        members AS (
          SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth,
                 unnest(list_transform(range(0, len(turns) + 1), lambda d: list_slice(turns, 1, d))) AS path
          FROM rebuilt),
        nodes AS (
          SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
          FROM members GROUP BY path),
        parents AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        own_totals AS (
          SELECT n.*, coalesce(n_children, 0) AS n_children,
                 CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(
                   substr(path[-1], instr(path[-1], chr(0)) + 1), '[^\x20\x09-\x0D]+')) END AS saved
          FROM nodes n LEFT JOIN parents USING (path)),
        above AS (
          SELECT unnest(list_transform(range(0, depth + 1), lambda d: list_slice(path, 1, d))) AS path,
                 CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, saved
          FROM own_totals),
        totals AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path)
        SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
        FROM own_totals o JOIN totals t ON o.path = t.path
        LEFT JOIN nodes p ON o.depth > 0 AND p.path = list_slice(o.path, 1, o.depth - 1)""",
}
