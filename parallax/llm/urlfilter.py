"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression with the whole tokens (runs of letters and digits) that every url it
fits must have. How often tokens of the rules occur is counted over all urls; each rule goes to the
index under its rarest token. The tokens of a url fetch candidate rules from the index, and only
those run their expressions. Host rules (host and subdomains, path prefix) win over patterns, the
longest first.

Up to ``LITERAL_RULES`` rules the index is a literal of the plan and nothing is shuffled. More rules are a table that the
tokens of the distinct urls are joined with: broadcast where it is small, else repeated for salts (``common.keyed``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.common import fresh, keyed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LITERAL_RULES = 200


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path. ``rank``: 1 for host rules, 0 for patterns."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    block: bool
    rank: int


def host_rule(name: str, block: bool) -> Rule:
    """``com/en/``: host com and its subdomains, paths that start with /en/."""
    host, slash, path = name.partition("/")
    whole = re.findall(r"[A-Za-z0-9]+", host) + re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", slash + path)
    end = "" if slash else r"(?=/|\z)"
    return Rule(name, f"^(?:[^/]*\\.)?{java_quote(host)}{java_quote(slash + path)}{end}", tuple(w.lower() for w in whole), block, 1)


def word_rule(*words: str) -> Rule:
    """Blocks urls that have the words as whole tokens, one after the other, in any case."""
    joined = "[^A-Za-z0-9]".join(words)
    return Rule("-".join(words), f"(?i)(?<![A-Za-z0-9]){joined}(?![A-Za-z0-9])", tuple(w.lower() for w in words), True, 0)


def rules_of(lines: Iterable[str]) -> tuple[Rule, ...]:
    """Rules of a list: ``block com/en/``, ``allow example.com`` (host, path), ``block word spam farm`` (whole words in a row).

    Empty lines and what follows a # after a space or at a line's start are left out; anything else raises an error.
    """
    found = []
    for line in lines:
        parts = re.sub(r"(^|\s)#.*", "", line).split()
        if not parts:
            continue
        if parts[0] not in ("allow", "block") or len(parts) < 2 or (parts[1] == "word") != (len(parts) > 2):
            raise ValueError(f"not a rule: {line!r}")
        if parts[1] == "word":
            found.append(replace(word_rule(*(re.escape(w) for w in parts[2:])), name="-".join(parts[2:]), tokens=tuple(w.lower() for w in parts[2:] if w.isalnum() and w.isascii()), block=parts[0] == "block"))
        else:
            found.append(host_rule(parts[1], parts[0] == "block"))
    return tuple(found)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """The rules of a file that Spark can read."""
    return rules_of(r["value"] for r in spark.read.text(path).collect())


def java_quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


RULES = (
    host_rule("com/en/", True),
    host_rule("example.com/en/7", False),
    host_rule("net/de/", False),
    host_rule("example.net/de/8", True),
    host_rule("org/es/", True),
)
#: What is judged where no host rule fits.
PATTERNS = (
    word_rule("spam", "farm"), word_rule("cheap", "pills"), word_rule("casino"), word_rule("viagra"), word_rule("porn"),
    word_rule("xxx"), word_rule("free", "download"), word_rule("malware"), word_rule("phishing"), word_rule("adult", "cams"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens_of(text: Column) -> Column:
    """In lower case, as those of rules are: which case counts is up to a rule's expression."""
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES + PATTERNS) -> DataFrame:
    """``pages`` (with ``url``) with host, path, rule (the host rule that won, else null) and verdict.

    A null url or one without :// has an empty host and path and is allowed, as is whatever no rule
    fits. Repeated rows and other columns stay; columns of the new names are replaced. Of host
    rules of one length the first by name wins. Where no rule has a whole token, a rule is tried on every url.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    new = ("host", "path", "rule", "verdict")
    split = pages.drop(*new).withColumns({"host": host, "path": path})
    site = F.concat("host", "path")
    at, won = fresh(split, "_site"), fresh(split, "_won")
    if len(rules) > LITERAL_RULES:
        best = by_tables(split.select(site.alias("site")).distinct(), rules).withColumnsRenamed({"site": at, "won": won})
        return verdicts(split.withColumn(at, site).join(best, at, "left"), at, won).select(*split.columns, "rule", "verdict")
    index = indexed(split.select(tokens_of(site).alias("tokens")), rules)
    fetched = F.flatten(F.transform(F.concat(tokens_of(site), F.array(F.lit(""))), lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast("array<int>"))))
    kind = "array<struct<id:int,rank:int,size:int,name:string,pattern:string,block:boolean>>"
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r.rank).alias("rank"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.block).alias("block")) for i, r in enumerate(rules)]).cast(kind)
    fitting = F.filter(F.transform(fetched, lambda i: F.get(known, i)), lambda r: F.rlike(F.col(at), r["pattern"]))
    best = F.array_sort(fitting, lambda a, b: F.coalesce(F.nullif(b["rank"] - a["rank"], F.lit(0)), F.nullif(b["size"] - a["size"], F.lit(0)), a["id"] - b["id"]))
    return verdicts(split.withColumn(at, site).withColumn(won, F.get(best, F.lit(0))), at, won)


def verdicts(judged: DataFrame, at: str, won: str) -> DataFrame:
    return judged.withColumns(
        {
            "rule": F.when(F.col(f"{won}.rank") == 1, F.col(f"{won}.name")),
            "verdict": F.when(F.coalesce(F.col(f"{won}.block"), F.lit(False)), "block").otherwise("allow"),
        }
    ).drop(at, won)


def indexed(urls: DataFrame, rules: tuple[Rule, ...]) -> Column:
    """Token -> positions of the rules whose rarest token it is, by counts over all urls; "" has rules without tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        own = F.array_intersect(F.col("tokens"), F.array(*map(F.lit, wanted)))
        counts = {r["token"]: r["n"] for r in urls.select(F.explode(own).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return F.create_map(*[x for t, at in by.items() for x in (F.lit(t), F.array(*map(F.lit, at)))]) if by else F.create_map(F.lit(""), F.array().cast("array<int>"))


def by_tables(sites: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(site, won) of the distinct ``sites`` that a rule fits."""
    spark = sites.sparkSession
    kind = "array<struct<id:int,rank:int,size:int,name:string,pattern:string,block:boolean,tokens:array<string>>>"
    parts = [json.dumps([{"id": i, "rank": r.rank, "size": len(r.name), "name": r.name, "pattern": r.pattern, "block": r.block, "tokens": r.tokens} for i, r in enumerate(rules[a : a + 1000], a)]) for a in range(0, len(rules), 1000)]
    known = stored(spark.range(1).select(F.explode(F.array(*map(F.lit, parts))).alias("part")).select(F.inline(F.from_json("part", kind))), "rules")
    wanted = known.select(F.explode("tokens").alias("token")).distinct()
    said = sites.select("site", F.explode(F.concat(tokens_of(F.col("site")), F.array(F.lit("")))).alias("token"))
    counts = keyed(said, wanted, len(rules), "token", "site").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = known.select("id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = each.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least")).select("id", "least.token")
    index = stored(known.join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit(""))).drop("tokens"), "index")
    fitting = keyed(said, index, len(rules), "token", "site").filter(F.rlike("site", F.col("pattern")))
    order = F.struct("rank", "size", (-F.col("id")).alias("id"), "name", "block")
    return fitting.groupBy("site").agg(F.max(order).alias("won"))
