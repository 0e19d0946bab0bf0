"""URL filter: a trie over reversed host labels and path segments, broadcast to the tasks.

The rules are a parameter (at most MOST_RULES of MOST_CHARACTERS together), so the trie has a bound; more are an error, and so
are two rules of one host and path with different verdicts. Each url walks the host labels from
the last to the first, and at each label with rules walks the path's segments. The match with the most host labels
wins, and among these the longest path, whether it allows or blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the rules (verdict, host, path) in the order given
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bounds of the broadcast trie: rules, and characters of all hosts and paths.
MOST_RULES, MOST_CHARACTERS = 1_000_000, 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class RuleTrie:
    """Two levels: labels of the host from the right, then segments of the path from the left.

    A node is a pair (children, rules); rules maps the start of the next segment, which may be empty, to a rule.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        characters = 0
        for n, (verdict, host, path) in enumerate(rules):
            characters += len(host) + len(path)
            if n >= MOST_RULES or characters > MOST_CHARACTERS:
                raise ValueError(f"more than {MOST_RULES} rules or {MOST_CHARACTERS} characters of rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/paths", {})  # no label has a slash
            *whole, start = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            own = node.setdefault("/starts", {}).setdefault(start, (host + path, verdict))
            if own[1] != verdict:
                raise ValueError(f"two verdicts for {host}{path}")

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            fits = [s for s in node.get("/starts", ()) if segment.startswith(s)]
            if fits:
                best = node["/starts"][max(fits, key=len)]
            if i == len(segments) - 1 or (node := node.get(segment)) is None:
                break
        return best

    def paths_of(self, host: str) -> list[dict]:
        """The path tries of the labels of a host that have rules, the longest host first."""
        out, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/paths" in node:
                out.append(node["/paths"])
        return out[::-1]

    def find(self, host: str, path: str, known: dict[str, list[dict]] | None = None) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None. known: path tries of hosts that were looked up before."""
        known = {} if known is None else known
        if host not in known:
            known[host] = self.paths_of(host)
        return next((found for node in known[host] if (found := self._path(node, path))), None)


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict.

    A null url, or one without "://", has an empty host and path, no rule and the default verdict. Repeated rows stay
    apart; an empty table gives an empty result; other columns are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in parts:
            known: dict[str, list[dict]] = {}  # each host of a batch is looked up once
            found = [find(h, p, known) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("_v", look_up("host", "path")).select("page_id", "host", "path", F.col("_v.rule").alias("rule"), F.col("_v.verdict").alias("verdict"))
