"""URL filters: every rule waits under its rarest literal token, and URL tokens call up the rules to try.

A rule can only fit a URL that holds all of the rule's literal tokens, so it is filed under the one
that the fewest distinct URLs hold. Tokens of distinct URLs fetch candidates by an equi-join, and only
those candidates run their regular expression. Built-in functions only.

Defined cases: a null url, or one without ://, has an empty host and path and no rule; repeated rows
are judged once and answered each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fold
from ledgerloom.operators.scale import stage


@dataclass(frozen=True)
class Rule:
    """A site rule (host and path prefix, subdomains included)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A pattern rule over the whole lower-cased URL; every token must be part of any URL that fits."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: Fixed values of the contract.
SITE_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

#: What is judged when no site rule fits: shops, games of chance, accounts, downloads.
PATTERNS = (
    Pattern(r"://[^/?#]*cheap-pills\.", ("cheap", "pills")),
    Pattern(r"://[^/?#]*\bcasino\b", ("casino",)),
    Pattern(r"://[^/?#]*\bfree-(?:porn|xxx)\b", ("free",)),
    Pattern(r"/wp-login\.php\b", ("wp", "login", "php")),
    Pattern(r"/checkout/(?:cart|payment)\b", ("checkout",)),
    Pattern(r"\.exe(?:[?#]|$)", ("exe",)),
)


def host_of(url: Column) -> Column:
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold(text), "[^0-9a-z]+"), lambda t: t != ""))


def literal_tokens(rule: Rule) -> tuple[str, ...]:
    """Tokens that any fitting URL holds whole: not the last of a path that could go on."""
    parts = [t for t in re.split("[^0-9a-z]+", rule.name.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    return tuple(t for t in (parts[:-1] if rule.path else parts) if t)


def rule_frame(spark: SparkSession, rules: tuple[Rule, ...], patterns: tuple[Pattern, ...]) -> DataFrame:
    """One row per rule: name (null for a pattern), verdict, regex, over_url, weight, tokens ('' if it has none)."""
    quote = lambda s: "".join(f"\\{c}" if re.match(r"[^0-9A-Za-z]", c) and ord(c) < 128 else c for c in s)
    rows = [(r.name, r.verdict, f"^(?:[^/]*[.])?{quote(r.host)}{quote(r.path) if r.path else '(?=/|$)'}", False, 1_000_000 + len(r.name), list(literal_tokens(r)) or [""]) for r in rules]
    rows += [(None, p.verdict, p.regex, True, len(p.regex), list(p.tokens) or [""]) for p in patterns]
    text = lambda s: F.lit(s).cast("string")
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(text(n).alias("name"), text(v).alias("rule_verdict"), text(x).alias("regex"), F.lit(o).alias("over_url"), F.lit(w).alias("weight"), F.array(*[text(t) for t in ts]).alias("tokens"))
        for n, v, x, o, w, ts in rows
    ])))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES, patterns: tuple[Pattern, ...] = PATTERNS, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; the longest site rule wins, else the longest pattern, else ``otherwise``.

    The columns of pages come as one struct ``row``, so none can clash.
    """
    spark = pages.sparkSession
    own = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), pages["url"].alias("asked"))
    urls = pages.select("url").where("url is not null").distinct()
    tokens = urls.select("url", F.explode(F.array_append(tokens_of(F.col("url")), F.lit(""))).alias("token"))
    book = rule_frame(spark, rules, patterns)
    filed = book.select("*", F.explode("tokens").alias("token")).drop("tokens")
    heard = tokens.join(filed.select("token").distinct(), "token").groupBy("token").count()
    index = stage(
        filed.join(heard, "token", "left")
        .groupBy("regex", "over_url", "name", "rule_verdict", "weight")
        .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    )
    tried = tokens.join(index, "token").withColumn(
        "subject", F.when(F.col("over_url"), fold(F.col("url"))).otherwise(F.concat(host_of(F.col("url")), path_of(F.col("url"))))
    ).where(F.rlike("subject", F.col("regex")))
    best = tried.groupBy("url").agg(F.max_by(F.struct("name", "rule_verdict"), F.struct("weight", "name", "regex")).alias("best"))
    joined = own.join(best, own["asked"] == best["url"], "left")
    return joined.select(
        "row", host_of(F.col("asked")).alias("host"), path_of(F.col("asked")).alias("path"),
        F.col("best.name").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"),
    )
