"""URL filter: a trie over reversed host labels and path segments, longest rule wins.

A rule is (host, path, verdict).  It fits a URL whose host is the rule's host or one of its
subdomains and whose path starts with the rule's path.  Among fitting rules the one with the
longest host + path text wins, then the longer host, then ``block`` over ``allow``.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import fresh, missing

#: Rules whose host and path texts sum up to more bytes than this are joined instead of broadcast.
TRIE_BYTES = 32_000_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Host labels from the top-level domain down; at each host a trie of path segments.

    The last piece of a rule path is a prefix of the URL's piece at that depth (so
    ``/en/1`` fits ``/en/12``); all pieces before it must be equal.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("label", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            rank = (len(host) + len(path), len(host), verdict == "block")
            ends = node.setdefault("ends", {})
            if last not in ends or ends[last][0] < rank:
                ends[last] = (rank, host + path, verdict)

    def match(self, host: str, path: str) -> tuple | None:
        """(rank, rule text, verdict) of the longest fitting rule, or None."""
        best, node = None, self.root
        pieces = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            at = node
            for piece in pieces:
                for prefix, end in at.get("ends", {}).items():
                    if piece.startswith(prefix) and (best is None or end[0] > best[0]):
                        best = end
                at = at.get(("segment", piece))
                if at is None:
                    break
        return best


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], host: str, path: str,
             out: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [f and f[1] for f in found],
                             "verdict": [f and f[2] for f in found]}, dtype=object)

    return urls.withColumn(out, judge(host, path))


def _by_join(urls: DataFrame, rules: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Same matches for rule tables beyond the broadcast bound: each distinct (host, path)
    posts one key per host suffix and leading path, rules post theirs, equal keys meet."""
    pieces, labels = F.split("__p", "/", -1), F.split("__h", r"\.", -1)
    pairs = urls.select(F.col(host).alias("__h"), F.col(path).alias("__p")).distinct()
    probe = pairs.select(
        "__h", "__p", pieces.alias("__s"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(
            F.slice(labels, -n, n), "."))).alias("__kh"))
    probe = probe.select(
        "__h", "__p", "__kh", F.posexplode("__s").alias("__d", "__piece"), "__s").select(
        "__h", "__p", "__kh", "__piece",
        F.array_join(F.slice("__s", 1, F.col("__d")), "/").alias("__kp"), "__d")
    cut = F.split("path", "/", -1)
    table = rules.select(
        F.col("host").alias("__kh"), F.array_join(F.slice(cut, 1, F.size(cut) - 1), "/").alias("__kp"),
        (F.size(cut) - 1).alias("__d"), F.element_at(cut, -1).alias("__last"),
        F.struct(F.length("host") + F.length("path"), F.length("host"),
                 (F.col("verdict") == "block"), F.concat("host", "path").alias("rule"),
                 "verdict").alias("__end"))
    best = (probe.join(table, ["__kh", "__kp", "__d"])
            .where(F.col("__piece").startswith(F.col("__last")))
            .groupBy("__h", "__p").agg(F.max("__end").alias("__end"))
            .select("__h", "__p", F.struct(F.col("__end.rule"), F.col("__end.verdict")).alias(out)))
    return urls.join(best, (urls[host] == best["__h"]) & (urls[path] == best["__p"]),
                     "left").drop(best["__h"], best["__p"])


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Append host, path, rule and verdict to every row of ``pages``.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  The size of the rule texts
    is summed first: up to ``trie_bytes`` the trie is broadcast, beyond that the rules are joined
    (same result).  URLs that are null or lack ``://`` have empty host and path, fit no rule with
    a host and get ``default``.  Repeated rows are judged alike, an empty table stays empty, an
    empty rule table judges all by ``default``.  Columns named host, path, rule or verdict in the
    input are replaced.
    """
    missing(pages, url)
    missing(rules, "host", "path", "verdict")
    rules = rules.select("host", "path", "verdict").dropna()
    base = pages.select(*[c for c in pages.columns if c == url or c.lower() not in
                          ("host", "path", "rule", "verdict")])
    h, p, v = fresh(base, "__host"), fresh(base, "__path"), fresh(base, "__verdict")
    urls = base.withColumn(h, url_host(F.col(url))).withColumn(p, url_path(F.col(url)))
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 100)).first()[0] or 0
    if size <= trie_bytes:
        judged = _by_trie(urls, [tuple(r) for r in rules.collect()], h, p, v)
    else:
        judged = _by_join(urls, rules, h, p, v)
    return judged.select(
        *base.columns, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{v}.rule"),
        F.coalesce(F.col(f"{v}.verdict"), F.lit(default)).alias("verdict"))
