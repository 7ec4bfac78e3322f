"""URL filters: pattern rules under their rarest literal token. DataFrame functions only.

Every rule, of a host and path or a free pattern, is indexed under one of the literal tokens that any URL it fits must
hold: the one that the fewest URLs hold. A URL's tokens fetch its candidate rules, and only those run their regular
expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains where the path starts as given, like ``example.com/en/``."""

    action: str
    rule: str

    @property
    def regex(self) -> str:
        host, path = self.rule.split("/", 1)
        return r"^(?:[^/]*\.)?" + _quoted(host) + _quoted("/" + path)

    @property
    def tokens(self) -> list[str]:
        # The last token counts only if the rule itself ends it.
        found = [m for m in _TOKEN.finditer(self.rule.lower())]
        return [m[0] for m in found if m.end() < len(self.rule)]


@dataclass(frozen=True)
class PatternRule:
    """Fits a URL in lower case that holds the pattern: literal text, ``*`` for anything, ``^`` for a separator or the end."""

    action: str
    rule: str

    @property
    def regex(self) -> str:
        out = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(p, _quoted(p)) for p in re.split(r"([*^])", self.rule) if p)
        return f"(?s){out}"

    @property
    def tokens(self) -> list[str]:
        # A token counts if neither end of it could go on: at the rule's ends, and beside a star, it might.
        marked = self.rule
        return [m[0] for m in _TOKEN.finditer(marked) if 0 < m.start() and m.end() < len(marked) and marked[m.start() - 1] != "*" and marked[m.end()] != "*"]


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" if c.isascii() else c for c in text)


# The rules of the query: five sites, the longest of which decides.
SITES = [
    SiteRule("allow", "com/"),
    SiteRule("block", "example.com/en/"),
    SiteRule("allow", "www.example.com/en/"),
    SiteRule("block", "net/es/"),
    SiteRule("block", "net/fr/"),
]

# Patterns for URLs that no site rule fits; an allowing pattern beats a blocking one.
PATTERNS = [
    PatternRule("block", "/spam-farm."),
    PatternRule("block", "-spam."),
    PatternRule("block", ".cheap-pills."),
    PatternRule("block", "/cheap-pills."),
    PatternRule("block", "/casino^"),
    PatternRule("block", ".casino-"),
    PatternRule("block", "-poker-"),
    PatternRule("block", "/ads/"),
    PatternRule("block", ".adserver."),
    PatternRule("block", "/banner^"),
    PatternRule("block", "/popup^"),
    PatternRule("block", "/wp-login.php^"),
    PatternRule("block", "/xxx/"),
    PatternRule("block", "?replytocom="),
    PatternRule("block", "&sessionid="),
    PatternRule("allow", "/about/ads/"),
    PatternRule("allow", "/help/popup^"),
]


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_of(urls: DataFrame, sites: list[SiteRule], patterns: list[PatternRule], tokens: str) -> DataFrame:
    """One row per rule with the token it is kept under: of its literal tokens the one that the fewest rows of ``urls``
    hold, counted over all of them; the counts are those of the rules' tokens, so they are no more than the rules hold.
    A rule without a usable token is kept under the empty token, which every URL asks for."""
    spark = urls.sparkSession
    rows = [(k, "site", r.action, r.rule, r.regex, r.tokens or [""]) for k, r in enumerate(sites)]
    rows += [(len(sites) + k, "pattern", r.action, r.rule, r.regex, r.tokens or [""]) for k, r in enumerate(patterns)]
    rules = spark.createDataFrame(rows, "k int, kind string, action string, rule string, regex string, tokens array<string>")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    choice = rules.select("k", F.explode("tokens").alias("token")).join(F.broadcast(held), "token", "left")
    best = choice.groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("best"))
    return rules.drop("tokens").join(F.broadcast(best), "k").select("k", "kind", "action", "rule", "regex", "best.token")


def judge(pages: DataFrame, url: str = "url", sites: list[SiteRule] | None = None, patterns: list[PatternRule] | None = None) -> DataFrame:
    """All rows and columns with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest site rule decides (ties by the rule's text); without one the patterns do, and a URL that nothing fits
    is allowed. A null URL, or one without ``://``, has an empty host and path, fits no site rule, and is judged by its
    patterns alone. Repeated URLs are judged once. Input columns named like a result give way.
    """
    sites, patterns = SITES if sites is None else sites, PATTERNS if patterns is None else patterns
    names = ["host", "path", "rule", "verdict"]
    rows = pages.select(*[c for c in pages.columns if c not in names or c == url]).withColumn(f"{P}u", F.coalesce(F.col(url), F.lit("")))
    distinct = rows.select(F.col(f"{P}u").alias("u")).distinct()
    low = F.lower("u")
    words = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0), F.array(F.lit(""))))
    urls = distinct.withColumns({"host": host_of("u"), "path": path_of("u"), "tokens": words})
    index = index_of(urls, sites, patterns, "tokens")
    asked = urls.select("u", "host", "path", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    fits = F.when(F.col("kind") == "site", F.rlike(F.concat("host", "path"), F.col("regex"))).otherwise(F.rlike(F.lower("u"), F.col("regex")))
    site = F.when(F.col("kind") == "site", F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("action")))
    by_url = asked.where(fits).groupBy("u").agg(
        F.max(site).alias("site"),
        F.max((F.col("kind") == "pattern") & (F.col("action") == "block")).alias("blocked"),
        F.max((F.col("kind") == "pattern") & (F.col("action") == "allow")).alias("spared"),
    )
    joined = rows.join(by_url, F.col(f"{P}u") == F.col("u"), "left")
    verdict = F.coalesce("site.action", F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("spared", F.lit(False)), "block").otherwise("allow"))
    kept = [c for c in rows.columns if c != f"{P}u"]
    return joined.select(*[c for c in kept if c not in names], host_of(url).alias("host"), path_of(url).alias("path"), F.col("site.rule").alias("rule"), verdict.alias("verdict"))


def oracle_sql() -> str:
    """The same verdicts in DuckDB's SQL: every rule against every URL, as there are few rules."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({lit(r.action)}, {lit(r.rule)}, {lit(r.rule.split('/', 1)[0])}, {lit('/' + r.rule.split('/', 1)[1])})" for r in SITES)
    any_of = lambda action: " OR ".join(f"regexp_matches(u, {lit(r.regex)})" for r in PATTERNS if r.action == action)
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(action, rule, h, q) AS (VALUES {values}),
best AS (
  SELECT DISTINCT p.url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT DISTINCT url, host, path FROM p) p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
  GROUP BY p.url)
SELECT p.page_id, p.host, p.path, best.rule,
       coalesce(best.action, CASE WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.url = best.url
"""
