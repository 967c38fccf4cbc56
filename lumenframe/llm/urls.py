"""URL filter: a trie over reversed host labels and path segments, broadcast, in which the longest matching rule decides.

A rule is `host/path`: it fits its host and all subdomains, if the url's path starts with the rule's path. The trie is walked label by
label from the top-level domain down; each host node holds a trie of path segments. The rules' number is checked before the broadcast:
beyond MOST_RULES, and for rules that come as a DataFrame, each distinct host and path meets the rules of its own labels and segments in
a shuffled join instead, with the same answers.

Defined results: a null url, or one without `://`, has an empty host and path and so meets no rule; it gets the default verdict, as
does every url that no rule fits. An empty path starts with no rule's path that has a slash. Repeated rows are judged each. Other
columns pass through unless they clash with the new ones, which then win. An empty table gives no rows. Of a rule that a list repeats
the first stands; of one that a DataFrame repeats, a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower

#: The most rules that are broadcast whole (about 200 bytes each).
MOST_RULES = 1_000_000


class RuleTrie:
    """host labels from the right -> path segments -> (rule, verdict). `longest` is the walk."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("host", {}).setdefault(label, {})
            *whole, last = f"/{path}".split("/")  # the last piece may be part of a segment of the url's
            node = node.setdefault("path", {})
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", []).append((last, (rule, verdict)))
            node["ends"].sort(key=lambda x: -len(x[0]))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, by its whole length; a tie in length goes to the deeper host."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("host", {}).get(label)
            if node is None:
                break
            at = node.get("path")
            for segment in segments:
                if at is None:
                    break
                for part, found in at.get("ends", ()):
                    if segment.startswith(part) and (best is None or len(found[0]) >= len(best[0])):
                        best = found
                        break
                at = at.get("segments", {}).get(segment)
        return best


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict. rules: (host/path, allow or block), as the module says; a DataFrame
    has them as rule and verdict."""
    others = [c for c in df.columns if c.lower() not in {"host", "path", "rule", "verdict"} and c != url]
    parsed = df.select(*(F.col(f"`{c}`") for c in others), F.col(url).alias(url), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        return _met(parsed, rules.groupBy("rule").agg(F.max("verdict").alias("verdict")), default)
    if len(rules) > MOST_RULES:
        listed = df.sparkSession.createDataFrame([(rule, verdict, k) for k, (rule, verdict) in enumerate(rules)], "rule string, verdict string, k long")
        return _met(parsed, listed.groupBy("rule").agg(F.min_by("verdict", "k").alias("verdict")), default)
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in parts:
            found = [trie.value.longest(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return parsed.withColumn("found", walk("host", "path")).select(*parsed.columns, "found.rule", "found.verdict")


def _met(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The join: a host's suffixes of labels and a path's whole segments against those of the rules, then the rest of each rule's path."""
    rule_path = F.expr("concat('/', substring(rule, length(substring_index(rule, '/', 1)) + 2))")
    keyed = rules.select(F.substring_index("rule", "/", 1).alias("rule_host"), rule_path.alias("rule_path"), "rule", "verdict").withColumn("folder", F.regexp_extract("rule_path", "(?s)^(.*/)", 1))
    split = parsed.select("host", "path").distinct().select("host", "path", F.split("host", r"\.", -1).alias("labels"), F.split("path", "/", -1).alias("segments"))
    suffixes = F.transform("labels", lambda x, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))
    folders = F.slice(F.transform("segments", lambda x, i: F.concat(F.array_join(F.slice("segments", 1, i + 1), "/"), F.lit("/"))), 1, F.size("segments") - 1)
    asked = split.select("host", "path", F.explode(suffixes).alias("rule_host"), folders.alias("folders")).select("host", "path", "rule_host", F.explode("folders").alias("folder"))
    fits = asked.join(keyed, ["rule_host", "folder"]).filter(F.col("path").startswith(F.col("rule_path")))
    longest = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host")))
    best = fits.groupBy("host", "path").agg(longest.alias("found"))
    return parsed.join(best, ["host", "path"], "left").select(*(F.col(f"`{c}`") for c in parsed.columns), "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
