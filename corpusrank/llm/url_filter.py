"""URL allow and block lists: a trie over reversed host labels and path segments, longest match first.

Rules are a list or a table. Up to MAX_RULES rules of MAX_BYTES they are built into one trie, which is broadcast: each
url walks at most its own labels and segments, however many rules there are. Beyond that every url asks a table of
rules for its own ends of the host and starts of the path: of the different addresses only, and only of as many labels
and characters as some rule has; the longest answer wins. Both ways give the same rows.

Defined cases: a null url, or one without `://`, has an empty host and path; such a host fits no rule. A url
that no rule fits gets no rule and the default verdict. A rule's longest match means most host labels, then
the longest path. Of rules with the same host and path, block wins. An unknown verdict raises. A null host or path of
a rule counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import ascii_lower, drop_columns, join_hot, unused_names

#: Bounds of the trie that is broadcast.
MAX_RULES, MAX_BYTES = 1_000_000, 64_000_000
RULE = "verdict string, host string, path string"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def build_trie(rules: Iterable[Rule]) -> dict:
    """Host nodes are {"next": {label: node}, "paths": path node}; path nodes are {"next": {segment: node}, "ends": {prefix: (rule, verdict)}}."""
    root: dict = {"next": {}, "paths": None}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node["next"].setdefault(label, {"next": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"next": {}, "ends": {}}
        at = node["paths"]
        *whole, last = path.split("/")
        for segment in whole:
            at = at["next"].setdefault(segment, {"next": {}, "ends": {}})
        if at["ends"].get(last, ("", ""))[1] != "block":
            at["ends"][last] = (host + path, verdict)
    return root


def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
    best, parts = None, path.split("/")
    for i, part in enumerate(parts):
        ends = node["ends"]
        if ends:
            fits = [p for p in ends if part.startswith(p)] if len(ends) <= len(part) else [part[:k] for k in range(len(part) + 1) if part[:k] in ends]
            if fits:
                best = ends[max(fits, key=len)]
        if i + 1 == len(parts) or part not in node["next"]:
            break
        node = node["next"][part]
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if node["paths"] is not None:
            best = _longest_path(node["paths"], path) or best
    return best


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: Iterable[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict (these replace columns of the same name). rules: a list, or a table (verdict, host, path)."""
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        small = len(rules) <= MAX_RULES and sum(len(r.host) + len(r.path) for r in map(Rule._make, rules)) <= MAX_BYTES
        if not small:
            rules = df.sparkSession.createDataFrame(rules, RULE)
    else:
        rules = rules.select("verdict", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")])
        n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
        small = n <= MAX_RULES and size <= MAX_BYTES
        if small:
            rules = [Rule(*r) for r in rules.collect()]
    url = F.col(f"`{url_col}`")
    host, path, found = unused_names(df, "host", "path", "judged")
    plain = df.withColumns({host: url_host(url), path: url_path(url)})
    judged = (_by_trie if small else _by_joins)(plain, rules, host, path, found)
    keep = drop_columns(df, "host", "path", "rule", "verdict").columns
    return judged.select(
        *[F.col(f"`{c}`") for c in keep], F.col(host).alias("host"), F.col(path).alias("path"),
        F.col(found)["rule"].alias("rule"), F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict"),
    )


def _by_trie(df: DataFrame, rules: list[Rule], host: str, path: str, found: str) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        answers = [lookup(trie.value, h, p) or (None, None) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(answers, columns=["rule", "verdict"], dtype=object)

    return df.withColumn(found, judged(host, path))


def _by_joins(df: DataFrame, rules: DataFrame, host: str, path: str, found: str) -> DataFrame:
    """Rules are met by equality of host and path. A host has no slash and a path of a url begins with one, so the two make one key."""
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")))))
    able = ~F.col("host").contains("/") & ((F.col("path") == "") | F.col("path").startswith("/"))  # others fit no url
    table = rules.withColumn("verdict", known).where(able)
    table = table.groupBy(F.concat("host", "path").alias("_key")).agg(F.max("verdict").alias("verdict"))  # block comes after allow
    table = materialize(table, "url-rules")
    at = F.locate("/", F.col("_key"))
    rule_host = F.when(at > 0, F.substring("_key", F.lit(1), at - 1)).otherwise(F.col("_key"))
    labels, chars = (F.size(F.split(rule_host, "\\."))), F.length("_key") - F.length(rule_host)
    sizes = table.agg(F.sort_array(F.collect_set(labels)).alias("labels"), F.sort_array(F.collect_set(chars)).alias("chars")).first()  # no longer than the longest rule
    counts, lengths = (F.array(*[F.lit(n) for n in some]).cast("array<int>") for some in (sizes["labels"], sizes["chars"]))

    (address,) = unused_names(df, "address")
    rows = df.withColumn(address, F.concat(host, path))
    seen = materialize(rows.select(F.col(address).alias("address"), F.col(host).alias("host"), F.col(path).alias("path")).distinct(), "url-addresses")
    ends = F.filter(counts, lambda n: n <= F.size(F.split("host", "\\.")))
    starts = F.filter(lengths, lambda n: n <= F.length("path"))
    asked = seen.withColumn("n", F.explode(ends)).withColumn("m", F.explode(starts))
    end = F.array_join(F.slice(F.split("host", "\\."), -F.col("n"), F.col("n")), ".")
    asked = materialize(asked.select("address", "n", "m", F.concat(end, F.substring("path", F.lit(1), F.col("m"))).alias("_key")), "url-keys")
    answers = join_hot(asked, table, "_key").groupBy("address").agg(F.max_by(F.struct(F.col("_key").alias("rule"), "verdict"), F.struct("n", "m")).alias(found))
    return join_hot(rows, answers.withColumnRenamed("address", address), address, "left").drop(address)
