"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` of a URL. In a pattern ``||`` at the start fits the named host and all its
subdomains, ``^`` stands for a separator (anything but a letter, digit, ``_``, ``-``, ``%``) or either end, ``*`` for
anything; all else is literal. A literal token is a run of ASCII letters and digits that the pattern closes on both
sides, so that every URL that fits the rule holds it as a whole token. Each rule is filed under the one of its tokens
that the fewest URLs of the input hold (counted over all of them); rules without such a token are tried on every URL.
A URL looks up its own tokens and runs the regular expressions of the rules found, and of no others.

Up to MAX_RULES rules the index is a literal of the plan, bucketed by a hash of the token: no join, no shuffle and no Python
on the rows. A longer list stays a table: rules are filed by the same rule in a join with the tokens' counts, URLs meet them
by an equi join on the token (``judge_urls_by_table``), and only rules without a token, tried on every URL, are a literal.
``parse_rules`` reads lines of the usual filter-list format.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MAX_RULES = 100_000
SEPARATOR = r"(?:[^A-Za-z0-9_%-]|^|$)"


@dataclass(frozen=True)
class UrlRule:
    """verdict for the URLs that fit pattern; of several, the highest tier and then the longest name decides."""

    pattern: str
    verdict: str
    tier: int = 0

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def regex(self) -> str:
        body = self.name
        head = r"^(?:[^/]*\.)?" if self.pattern.startswith("||") else ""
        if head and "/" not in body and not body.endswith("^"):
            body += "^"
        return "(?s)" + head + "".join({"*": ".*", "^": SEPARATOR}.get(x) or re.sub(r"[^A-Za-z0-9/]", lambda m: "\\" + m[0], x) for x in body)

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that literal separators or the pattern's anchors close on both sides."""
        body, host = self.name, self.pattern.startswith("||")
        closed = lambda i: i < 0 and host or i >= len(body) and host and "/" not in body or 0 <= i < len(body) and body[i] != "*"
        return [m[0] for m in re.finditer(r"[A-Za-z0-9]+", body) if closed(m.start() - 1) and closed(m.end())]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    part = lambda kept: F.coalesce(F.regexp_extract(url, rf"(?s)^.*?://{kept}", 1), F.lit(""))
    return ascii_lower(part("([^/?#]*)")), part("[^/?#]*([^?#]*)")


def url_tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, "[^A-Za-z0-9]+"), lambda t: t != ""))


def _hash(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def token_counts(norms: DataFrame, rules: Sequence[UrlRule]) -> dict[str, int]:
    """How many rows hold each token that a rule has; counted over all rows, at most one result row for each such token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = norms.select(F.explode(url_tokens(F.col("norm"))).alias("token")).filter(F.col("token").isin(wanted))
    return {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count("*").alias("n")).collect()}


def file_rules(rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """The rules that have a token, each with its rarest, and the rules that have none."""
    filed, always = [], []
    for at, rule in enumerate(rules):
        entry = {"regex": rule.regex, "tier": rule.tier, "size": len(rule.name), "at": -at, "verdict": rule.verdict, "name": rule.name}
        if tokens := rule.tokens:
            filed.append(entry | {"token": min(tokens, key=lambda t: (counts.get(t, 0), t))})
        else:
            always.append(entry)
    return filed, always


ENTRY = "struct<token:string,regex:string,tier:int,size:int,at:int,verdict:string,name:string>"


def judge_urls(df: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (name of the deciding rule, null if none) and verdict (the rule's, else default).

    rule_tier is the deciding rule's tier. Input columns of these four names are replaced. A null URL or one without ``://`` has an empty host and path, so only
    rules that fit the empty string can apply. Repeated rows stay repeated; an empty table stays empty.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit a plan literal")
    host, path = url_parts(F.col(url))
    out = df.withColumns({"host": host, "path": path})
    norm = F.concat("host", "path")
    filed, always = file_rules(rules, token_counts(out.select(norm.alias("norm")), rules))
    buckets = max(1, 2 * len(filed))
    spark = df.sparkSession
    # Spark's own hash decides the bucket, as it does for the tokens of a URL
    placed = {r["token"]: r["b"] for r in spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in sorted({e["token"] for e in filed})] or [F.lit("")])).alias("token")).select("token", _hash(F.col("token"), buckets).alias("b")).collect()}
    shelves: list[list] = [[] for _ in range(buckets)]
    for e in filed:
        shelves[placed[e["token"]]].append(e)
    index = F.from_json(F.lit(json.dumps(shelves)), f"array<array<{ENTRY}>>")
    anywhere = F.from_json(F.lit(json.dumps(always)), f"array<{ENTRY}>")
    found = F.flatten(F.transform(url_tokens(norm), lambda t: F.filter(F.get(index, _hash(t, buckets)), lambda e: e["token"] == t)))
    hits = F.filter(F.concat(found, anywhere), lambda e: F.regexp_like(norm, e["regex"]))
    best = F.array_max(F.transform(hits, lambda e: F.struct(e["tier"], e["size"], e["at"], e["verdict"], e["name"])))
    return (
        out.withColumn("__best", best)
        .withColumns({"rule": F.col("__best.name"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default)), "rule_tier": F.col("__best.tier")})
        .drop("__best")
    )


def parse_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """pattern, verdict, tier of a filter list's lines: ``||host^``, ``/path/``, ``@@`` before what is allowed (tier 1).

    Comments (``!``), headings (``[``), rules on page elements (``##`` and the like), regular expressions (``/.../``) and rules
    with options (``$``) are left out, as are nulls, blank lines and patterns without a letter or digit. ``|`` at either end,
    an anchor of the whole address, is dropped: rules are over host and path.
    """
    line = F.trim(F.col(column))
    kept = lines.filter(line.isNotNull() & ~line.rlike(r"^(!|\[)|#@?\??#|\$|^(@@)?/.*[^/]/$.*") & line.rlike("[A-Za-z0-9]")).select(line.alias("l"))
    allowed = F.col("l").startswith("@@")
    body = F.regexp_replace(F.regexp_replace("l", "^@@", ""), r"(^\|(?!\|)(https?://)?)|(\|$)", "")
    return kept.select(body.alias("pattern"), F.when(allowed, "allow").otherwise("block").alias("verdict"), allowed.cast("int").alias("tier")).distinct()


def _entries(rules: DataFrame) -> DataFrame:
    """pattern, verdict, tier, name, regex, tokens of a table of rules: what UrlRule says of each, as expressions."""
    host = F.col("pattern").startswith("||")
    name = F.regexp_replace("pattern", r"^\|\|", "")
    bare = host & ~F.contains(name, F.lit("/"))
    body = F.when(bare & ~name.endswith("^"), F.concat(name, F.lit("^"))).otherwise(name)
    literal = F.regexp_replace(body, r"([^A-Za-z0-9/*^])", r"\\$1")
    regex = F.concat(F.lit("(?s)"), F.when(host, r"^(?:[^/]*\.)?").otherwise(""), F.replace(F.replace(literal, F.lit("^"), F.lit(SEPARATOR)), F.lit("*"), F.lit(".*")))
    # a star at an end stands for what the pattern does not close there
    closed = F.concat(F.when(host, "/").otherwise("*"), name, F.when(bare, "/").otherwise("*"))
    tokens = F.array_distinct(F.regexp_extract_all(closed, F.lit(r"(?<![A-Za-z0-9*])([A-Za-z0-9]+)(?![A-Za-z0-9*])"), F.lit(1)))
    return rules.withColumns({"name": name, "tokens": tokens}).withColumn("regex", regex)


def judge_urls_by_table(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most: int = MAX_RULES) -> DataFrame:
    """judge_urls with a table of rules (pattern, verdict and, if it has one, tier; null is 0), however many they are.

    Up to ``most`` rules are a literal of the plan. Of more, each is filed under its rarest token, and distinct URLs meet
    them by an equi join; what several rules say is settled in one aggregation. Rules without a token are tried on every
    URL: more than ``most`` of those raise ValueError. Rows without pattern or verdict are left out, repeated rules are one.
    """
    tier = F.coalesce(F.col("tier"), F.lit(0)) if "tier" in rules.columns else F.lit(0)
    kept = rules.select("pattern", "verdict", tier.cast("int").alias("tier")).dropna().distinct()
    if kept.limit(most + 1).count() <= most:
        return judge_urls(df, read_rules(kept), url, default)
    entries = _entries(kept)
    loose = entries.filter(F.size("tokens") == 0).drop("tokens").limit(most + 1).collect()
    if len(loose) > most:
        raise ValueError(f"more than {most} rules without a token")
    host, path = url_parts(F.col(url))
    norm = F.concat("host", "path")
    out = df.withColumns({"host": host, "path": path}).withColumn("__norm", norm)
    seen = out.groupBy(F.col("__norm").alias("norm")).agg(F.count("*").alias("n"))
    wanted = entries.select(F.explode("tokens").alias("token")).distinct()
    tokens = seen.select("norm", "n", F.explode(url_tokens(F.col("norm"))).alias("token")).join(wanted, "token", "left_semi")
    counts = tokens.groupBy("token").agg(F.sum("n").alias("n"))
    rule = ["pattern", "verdict", "tier", "name", "regex"]
    each = entries.select(*rule, F.explode("tokens").alias("token")).join(counts, "token", "left")
    filed = each.groupBy(*rule).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    hits = tokens.select("norm", "token").join(filed, "token").filter(F.regexp_like("norm", F.col("regex"))).select("norm", *rule)
    anywhere = F.from_json(F.lit(json.dumps([r.asDict() for r in loose])), "array<struct<pattern:string,verdict:string,tier:int,name:string,regex:string>>")
    tried = seen.select("norm", F.explode(F.filter(anywhere, lambda e: F.regexp_like("norm", e["regex"]))).alias("e")).select("norm", *[F.col(f"e.{c}").alias(c) for c in rule])
    # the highest tier, the longest name, then the first in the order that read_rules has
    best = F.min(F.struct((-F.col("tier")).alias("t"), (-F.length("name")).alias("s"), "pattern", "verdict", "name", "tier")).alias("__best")
    chosen = hits.unionByName(tried).groupBy(F.col("norm").alias("__norm")).agg(best)
    met = out.join(chosen, "__norm", "left")
    met = met.withColumns({"rule": F.col("__best.name"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default)), "rule_tier": F.col("__best.tier")})
    return met.drop("__best", "__norm")


#: The contract's rules; they outrank the method's own.
BASE_RULES = [
    UrlRule("||com/en/", "block", 1), UrlRule("||example.com/en/7", "allow", 1), UrlRule("||net/de/", "allow", 1),
    UrlRule("||example.net/de/8", "block", 1), UrlRule("||org/es/", "block", 1),
]
# Spam names, wherever they stand as a label, and words that start the label of a host to be blocked.
SPAM_NAMES = ("casino-win", "free-bets", "cheap-pills", "adult-cam", "xxx-videos", "payday-loans", "hot-singles")
SPAM_WORDS = ("adult", "ads", "bets", "cams", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "xxx")
SPAM_RULES = [UrlRule(f"^{x}.", "block") for x in SPAM_NAMES] + [UrlRule(f"||{w}{c}*", "block") for w in SPAM_WORDS for c in "-."]


def read_rules(rules: DataFrame) -> list[UrlRule]:
    """Rules from a table of pattern, verdict and tier (0 where it is null or missing), by tier, pattern and verdict.

    At most MAX_RULES, counted first; rows without pattern or verdict are left out, repeated rules are one.
    """
    tier = F.coalesce(F.col("tier"), F.lit(0)) if "tier" in rules.columns else F.lit(0)
    kept = rules.select("pattern", "verdict", tier.cast("int").alias("tier")).dropna().distinct()
    if (n := kept.count()) > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES} fit a plan literal")
    return [UrlRule(r["pattern"], r["verdict"], r["tier"]) for r in kept.orderBy("tier", "pattern", "verdict").collect()]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict of the base's and the method's rules on every page's URL. A null one has an empty host and path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge_urls(pages, [*BASE_RULES, *SPAM_RULES])
    return out.select("page_id", "host", "path", F.when(F.col("rule_tier") == 1, F.col("rule")).alias("rule"), "verdict")


_SPAM, _WORDS = "|".join(SPAM_NAMES), "|".join(SPAM_WORDS)
OP9_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
decided AS (
  SELECT p.*, (SELECT max(struct_pack(size := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := verdict))
               FROM rules WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9_%-])({_SPAM})[.]') OR regexp_matches(host, '(^|[.])({_WORDS})[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM decided
"""
