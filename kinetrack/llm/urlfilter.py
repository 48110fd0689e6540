"""URL filtering with pattern rules that are indexed by their rarest literal token.

Every rule is filed under the one of its literal tokens that fewest URLs hold. A URL's tokens fetch the rules filed
under them; only these run their regular expression. Everything is a built-in expression: no shuffle, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over ``host + path``, where the path is empty or starts with a slash."""
        return rf"\A(?:[^/]*\.)?{_quoted(self.host)}{_quoted(self.path)}" + ("" if self.path else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that each matching URL holds whole: host labels, and path segments that the rule closes."""
        segments = self.path.split("/")[1:-1]
        return [t for t in [*self.host.split("."), *segments] if t]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def parse_rule(line: str) -> Rule:
    """``block example.com/en/`` -> Rule."""
    verdict, pattern = line.split(None, 1)
    host, slash, path = pattern.strip().partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, "/")))


def token_counts(pages: DataFrame, url_col: str, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands; one row per token of the rules, whatever the pages."""
    wanted = sorted({t for r in rules for t in r.tokens})
    url = F.col(url_col)
    held = F.array_intersect(tokens_of(host_of(url), path_of(url)), F.array(*map(F.lit, wanted)))
    return {r["t"]: r["n"] for r in pages.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (the longest that fits, or null), verdict (the rule's, else ``default``).

    Of rules of equal length that both fit, the one that sorts last wins. Null and malformed URLs have an empty host
    and path and meet no rule. Rules are given by the caller, and so bounded: they travel inside the expression.
    """
    rules = sorted(set(rules), key=lambda r: (r.name, r.verdict))
    table = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if not rules:
        return table.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    counts = token_counts(table, "url", rules)
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    filed = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*[_struct(r) for r in rs]))])
    split = table.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fetched = F.flatten(F.transform(F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, index))), lambda t: filed[t]))
    target = F.concat("host", "path")
    fits = F.filter(fetched, lambda r: F.rlike(target, r["pattern"]))
    best = F.array_max(fits)
    return split.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
