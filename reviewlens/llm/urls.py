"""URL filters: pattern rules found by their rarest literal token.

A rule allows or blocks a host, its subdomains and the paths below a prefix, in which `*` stands for
any run of characters. Each rule is filed under that one of its literal tokens which the fewest tokens
of the given URLs equal; the tokens of a URL fetch the rules filed under them, and only those run
their regular expressions, the longest first. Rules without a literal token are fetched by every URL.

The host is what stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower
case; the path goes on from there to `?`, `#` or the end. A null URL, or one without `://`, has neither.
No rule: verdict "allow", rule null. Rules of equal length: the one listed first. Nulls and repeats
among page identifiers are kept as rows. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VERDICT = "allow"

# Rules that go to every executor at once; a longer list is tried in as many passes as it takes.
RULES_PER_PASS = 200_000

TOKEN = re.compile(r"[0-9A-Za-z]+")
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str
    pattern: str = field(init=False)
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        path = ".*".join(map(re.escape, self.path.split("*")))
        object.__setattr__(self, "pattern", rf"(?s)(?:[^/]*\.)?{re.escape(self.host)}{path}")
        # A token counts only if the URL cannot go on with it: what follows it stands in the rule.
        text = self.name.split("*")
        whole = []
        for n, part in enumerate(text):
            for found in TOKEN.finditer(part):
                if (n == 0 or found.start() > 0) and found.end() < len(part):
                    whole.append(found.group())
        object.__setattr__(self, "tokens", tuple(dict.fromkeys(whole)))

    @property
    def name(self) -> str:
        return self.host + self.path


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Sequence[Rule], frequency: dict[str, int]):
        self.by_token: dict[str | None, list[tuple[int, int, Rule]]] = {}
        for order, rule in enumerate(rules):
            rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t), default=None)
            self.by_token.setdefault(rarest, []).append((-len(rule.name), order, rule))
        self._compiled: dict[str, re.Pattern] = {}

    def candidates(self, address: str) -> list[Rule]:
        """The rules filed under a token of `address`, the longest first."""
        found = list(self.by_token.get(None, ()))
        for token in set(TOKEN.findall(address)):
            found.extend(self.by_token.get(token, ()))
        found.sort(key=lambda entry: entry[:2])
        return [rule for _, _, rule in found]

    def match(self, address: str) -> Rule | None:
        for rule in self.candidates(address):
            pattern = self._compiled.get(rule.pattern) or self._compiled.setdefault(rule.pattern, re.compile(rule.pattern))
            if pattern.match(address):
                return rule
        return None


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_TO_LOWER), _PATH.match(rest, len(host)).group()


def token_frequency(pages: DataFrame, tokens: Iterable[str], url: str = "url") -> dict[str, int]:
    """How many of the URLs have each of the given tokens: one row per token and task is shuffled, and one
    per token comes back."""
    wanted = frozenset(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for address in batch.column(0).to_pylist():
                counts.update(wanted.intersection(TOKEN.findall("".join(split_url(address)))))
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    counted = pages.select(F.col(url).cast("string").alias("url")).mapInArrow(count, "token string, n bigint")
    return dict(map(tuple, counted.groupBy("token").agg(F.sum("n")).collect()))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    default: str = DEFAULT_VERDICT,
    rules_per_pass: int = RULES_PER_PASS,
) -> DataFrame:
    """One row per page: its identifier under `key`, host, path, rule and verdict."""
    judged = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    judged = judged.withColumns({"rule": none, "verdict": none})
    for start in range(0, max(1, len(rules)), rules_per_pass):
        part = rules[start : start + rules_per_pass]
        frequency = token_frequency(pages, (t for rule in part for t in rule.tokens), url)
        index = pages.sparkSession.sparkContext.broadcast(Index(part, frequency))
        fields = [judged.schema["page_id"], *[T.StructField(n, T.StringType()) for n in ("url", "host", "path", "rule", "verdict")]]
        judged = judged.mapInArrow(_judge(index), T.StructType(fields))
    verdict = F.coalesce("verdict", F.lit(default)).alias("verdict")
    return judged.select(F.col("page_id").alias(key), "host", "path", "rule", verdict)


def _judge(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            split = [split_url(address) for address in urls]
            rules, verdicts = [], []
            for address, rule, verdict in zip(split, batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()):
                found = index.value.match("".join(address))
                if found is not None and (rule is None or len(found.name) > len(rule)):
                    rule, verdict = found.name, found.verdict
                rules.append(rule)
                verdicts.append(verdict)
            text = [batch.column("url"), *(pa.array(c, pa.string()) for c in ([h for h, _ in split], [p for _, p in split], rules, verdicts))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *text], ["page_id", "url", "host", "path", "rule", "verdict"])

    return run
