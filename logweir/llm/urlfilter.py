"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

A rule is a host and a path that begins and ends with "/" (`example.net/en/`, `net/`). It fits a url
whose host is the rule's or a subdomain of it and whose path starts with the rule's path. Of the rules
that fit, the longest text wins; of two equally long, the one with the longer host; of the same text
as block and allow, block. No rule: the default verdict.

Defined cases: a null url, or one without "://", has an empty host and path, which no rule fits.
Repeated rows are judged one by one. An empty table gives an empty result. Columns of the input other
than the named two are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast at the most; more of them are joined by a shuffle.
MAX_BROADCAST_RULES = 200_000
Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right, then under "" path segments, then under None the rule."""
    trie: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not path.startswith("/") or not path.endswith("/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
        node = trie
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("", {})
        for segment in path.split("/")[1:-1]:
            node = node.setdefault(segment, {})
        if node.get(None, ("", ""))[1] != "block":
            node[None] = (host + path, verdict)
    return trie


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule text and verdict that hold for a url."""
    best, segments, node = None, path.split("/")[1:-1] if path.startswith("/") else None, trie
    if segments is None:
        return None
    for label in reversed(host.split(".")):
        if not label or (node := node.get(label)) is None:
            break
        under = node.get("")
        for segment in [None, *segments]:
            if under is not None and segment is not None:
                under = under.get(segment)
            if under is None:
                break
            if (rule := under.get(None)) and (best is None or len(rule[0]) >= len(best[0])):
                best = rule
    return best


def judge_urls(df: DataFrame, rules: Iterable[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (null without one) and verdict of every row.

    rules: (verdict, host, path) records, or a DataFrame with these columns. Up to
    MAX_BROADCAST_RULES are broadcast as a trie; a larger DataFrame is joined on the host suffixes and
    path prefixes of each url, of which there are as many as it has labels times segments.
    """
    urls = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        if len(some := rules.select("verdict", "host", "path").limit(MAX_BROADCAST_RULES + 1).collect()) > MAX_BROADCAST_RULES:
            return _joined(urls, rules, id_col, default)
        rules = [tuple(r) for r in some]
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        held = trie.value
        found = [longest_match(held, h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return urls.withColumn("judged_", judged("host", "path")).select(id_col, "host", "path", "judged_.rule", "judged_.verdict")


def _joined(urls: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same by a shuffle join: once for each distinct pair of host and path."""
    texts = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "verdict").groupBy("rule", "host_len").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"
    pairs = urls.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")))
    tried = pairs.filter(F.col("path").startswith("/")).select("host", "path", F.explode(hosts).alias("h")).filter("h != ''").select("host", "path", "h", F.explode(paths).alias("p"))
    best = tried.select("host", "path", F.concat("h", "p").alias("rule"), F.length("h").alias("host_len")).join(texts, ["rule", "host_len"]).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "verdict", "rule")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
