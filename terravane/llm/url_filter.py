r"""URL filters (native: DataFrame functions only).

A rule is a regular expression over ``host + path`` together with the literal
tokens (runs of ``[a-z0-9]``) that every match holds as whole tokens.  Rules are
indexed by the one of their tokens that is rarest in the table at hand; a URL's
own tokens fetch the candidates, and only those expressions run.  The index is a
hashed array literal, so a URL is judged in one projection without a shuffle;
its size follows the rule list, never the data.

Defined results: a null URL or one without ``://`` has empty host and path and
no rule; repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``named`` rules are reported and win over pattern rules; the longest of them wins."""

    label: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool = True
    weight: int = field(default=0)


def path_rule(action: str, label: str) -> Rule:
    """A rule ``host/path-prefix`` that fits the host and its subdomains."""
    host, _, rest = label.partition("/")
    bounded = re.match(r"(.*/)?", rest)[0]  # a last part without a slash is a prefix, not a token
    tokens = tuple(re.findall(TOKEN, f"{host}/{bounded}"))
    return Rule(label, action, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(rest)}", tokens, True, len(label))


def host_word_rule(words: str) -> Rule:
    """Blocks hosts with a label that holds the hyphenated words as whole parts."""
    tokens = tuple(re.findall(TOKEN, words))
    return Rule(words, "block", rf"^([^/]*[^a-z0-9/])?{re.escape(words)}([^a-z0-9/][^/]*)?(/|$)", tokens, False, len(words))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, subject: Column, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each rule token: at most one row per token comes back."""
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(subject, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))).alias("token"))
    return {r[0]: r[1] for r in found.where(F.col("token").isin(sorted(tokens))).groupBy("token").count().collect()} if tokens else {}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """Buckets of (token, rule) by crc32 of the token, as an array literal."""
    import zlib

    size = 1
    while size < 2 * len(rules):
        size *= 2
    buckets: list[list[Column]] = [[] for _ in range(size)]
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        entry = F.struct(
            F.lit(token).alias("token"), F.lit(r.named).alias("named"), F.lit(r.weight).alias("weight"), F.lit(r.label).alias("label"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern")
        )
        buckets[zlib.crc32(token.encode()) % size].append(entry)
    empty = "array<struct<token:string,named:boolean,weight:int,label:string,action:string,pattern:string>>"
    return F.array(*(F.array(*b).cast(empty) if b else F.array().cast(empty) for b in buckets)), size


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (of named rules), ``verdict`` and ``reason`` in a struct ``__tv_url``."""
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token cannot be indexed")
    url = F.col(url_col)
    parts = pages.withColumn("__tv_host", host_of(url)).withColumn("__tv_path", path_of(url))
    subject = F.concat("__tv_host", "__tv_path")
    index, size = _index(rules, token_counts(parts, subject, {t for r in rules for t in r.tokens}))
    own = F.array_distinct(F.regexp_extract_all(F.translate(subject, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))
    fetched = F.flatten(F.transform(own, lambda t: F.filter(F.get(index, (F.crc32(t.cast("binary")) % size).cast("int")), lambda e: e["token"] == t)))
    hits = F.filter(fetched, lambda e: F.regexp_like(subject, e["pattern"]))
    best = F.array_max(F.transform(hits, lambda e: F.struct(e["named"].alias("named"), e["weight"].alias("weight"), e["label"].alias("label"), e["action"].alias("action"))))
    judged = parts.withColumn("__tv_best", F.explode(F.array(best)))  # a generator, so the match is not computed again for each field
    out = F.struct(
        F.col("__tv_host").alias("host"),
        F.col("__tv_path").alias("path"),
        F.when(F.col("__tv_best.named"), F.col("__tv_best.label")).alias("rule"),
        F.coalesce("__tv_best.action", F.lit("allow")).alias("verdict"),
        F.col("__tv_best.label").alias("reason"),
    )
    return judged.withColumn("__tv_url", out).drop("__tv_host", "__tv_path", "__tv_best")
