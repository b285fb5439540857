"""URL filters: rules found through their rarest literal token.

A rule is either a site rule, host and path prefix (`example.com/en/`: the host and all its subdomains, paths that
start with the prefix), or a pattern for the rest: text with `*` for anything, matched anywhere in the lower-cased url.
Each rule turns into a regular expression and keys that any url it fits must have: its literal tokens (runs of a-z and
0-9), `=ads`, and where the rule leaves a token open on one side, the token's beginning or end: `^exe`, `$exe`. Keys are
counted over all urls, and each rule is filed under its rarest one. A url's tokens fetch the rules filed under them, and
only those run their regular expressions. A pattern without a key (all its literals open on both sides) runs on every url.

The longest site rule that fits decides; else the longest pattern; else the default verdict.

Bound: the rules are a parameter, checked against MAX_RULE_BYTES before they are broadcast. Beyond it filter_by_join does
the same with the rules as a table, joined by key.

Defined results: a null url has empty host and path, fits no rule and gets the default; a url without `://` has empty
host and path too, so that no site rule fits it, but patterns are held against the whole of it and may decide;
repeated urls are judged alike; an empty table gives an empty result. Ports and user names are part of the host.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
MAX_RULE_BYTES = 64 << 20
TOKEN = re.compile("[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SITES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))
#: Trackers, advertisements and sign-in pages.
PATTERNS = (
    ("/ads/", BLOCK), ("/banner/", BLOCK), ("/track*/click", BLOCK), ("utm_source=feed", BLOCK), ("/login?", BLOCK), ("//ads.", BLOCK),
    ("//ads.*/about/", ALLOW), (".exe", BLOCK), ("?sessionid=", BLOCK), ("/wp-admin/", BLOCK),
)
DEFAULT = ALLOW


class Rule(NamedTuple):
    rule: str
    verdict: str
    site: bool
    regex: str
    keys: frozenset[str]


def keys_of(text: str, start: int = 0) -> frozenset[str]:
    """The keys of a rule's text, whose tokens are open at its end, at wildcards, and at its beginning unless start is -1."""
    out = set()
    for m in TOKEN.finditer(text):
        left = m.start() > start and text[m.start() - 1 : m.start()] != "*"
        right = m.end() < len(text) and text[m.end()] != "*"
        if left or right:
            out.add(("=" if left and right else "^" if left else "$") + m[0])
    return frozenset(out)


def site_rule(rule: str, verdict: str) -> Rule:
    """A rule on host + path, such as net/es/."""
    return Rule(rule, verdict, True, f"(?s)(?:[^/]*\\.)?{re.escape(rule)}", keys_of(rule.lower().replace("*", "\0"), -1))


def pattern_rule(rule: str, verdict: str) -> Rule:
    """A rule on the lower-cased url."""
    text = rule.lower()
    return Rule(rule, verdict, False, "(?s)" + ".*".join(map(re.escape, text.split("*"))), keys_of(text))


class Features:
    """The keys that an url has, of those that some rule has."""

    def __init__(self, keys: frozenset[str]):
        self.keys = keys
        self.sizes = {kind: sorted({len(k) - 1 for k in keys if k[0] == kind}) for kind in "^$"}

    def __call__(self, low: str) -> set[str]:
        tokens = set(TOKEN.findall(low))
        found = {"=" + t for t in tokens}
        found |= {"^" + t[:n] for n in self.sizes["^"] for t in tokens if len(t) >= n}
        found |= {"$" + t[-n:] for n in self.sizes["$"] for t in tokens if len(t) >= n}
        return found & self.keys


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many urls have each of the rules' keys, added up task by task: no more rows than the rules have keys."""
    features = Features(frozenset(k for r in rules for k in r.keys))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter[str] = Counter()
        for batch in batches:
            for url in batch["url"]:
                if isinstance(url, str):
                    tally.update(features(url.lower()))
        if tally:
            yield pd.DataFrame({"key": list(tally), "n": list(tally.values())})

    return {r["key"]: r["n"] for r in urls.mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def rarest(rules: list[Rule], counts: dict[str, int]) -> list[tuple[str | None, Rule]]:
    """Each rule behind the key it is filed under; None if it has none."""
    return [(min(r.keys, key=lambda t: (counts.get(t, 0), t), default=None), r) for r in rules]


def preference(rule: Rule) -> tuple:
    return (rule.site, len(rule.rule), rule.rule)


class Judge:
    def __init__(self, filed: list[tuple[str | None, Rule]]):
        self.always: list[tuple[re.Pattern, Rule]] = []
        self.under: dict[str, list[tuple[re.Pattern, Rule]]] = defaultdict(list)
        for key, rule in filed:
            (self.always if key is None else self.under[key]).append((re.compile(rule.regex), rule))
        self.features = Features(frozenset(self.under))

    def __call__(self, url: str | None, host: str, path: str) -> Rule | None:
        if not isinstance(url, str):
            return None
        low, site, best = url.lower(), host + path, None
        found = [x for key in self.features(low) for x in self.under[key]]
        for regex, rule in [*self.always, *found] if self.always else found:
            if (best is None or preference(rule) > preference(best)) and (regex.match(site) if rule.site else regex.search(low)):
                best = rule
        return best


def filter_urls(pages: DataFrame, sites: tuple = SITES, patterns: tuple = PATTERNS, default: str = DEFAULT) -> DataFrame:
    """row (all columns of pages), host, path, rule (of site rules), verdict and pattern (the pattern that decided)."""
    rules = [site_rule(*x) for x in sites] + [pattern_rule(*x) for x in patterns]
    if (size := len(pickle.dumps(rules))) > MAX_RULE_BYTES:
        raise ValueError(f"the rules take {size} bytes, over {MAX_RULE_BYTES}: use filter_by_join")
    filed = pages.sparkSession.sparkContext.broadcast(rarest(rules, key_counts(pages.select("url"), rules)))

    @F.pandas_udf("rule string, verdict string, pattern string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = Judge(filed.value)
        for columns in batches:
            best = [judge(*x) for x in zip(*columns, strict=True)]
            yield pd.DataFrame(
                {
                    "rule": [r.rule if r and r.site else None for r in best],
                    "verdict": [r.verdict if r else default for r in best],
                    "pattern": [r.rule if r and not r.site else None for r in best],
                },
                dtype=object,
            )

    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    said = split.select("row", "host", "path", judged("url", "host", "path").alias("said"))
    return said.select("row", "host", "path", "said.rule", "said.verdict", "said.pattern")


def parts_of(tokens: Column, kind: str, size: int) -> Column:
    """The keys `^` or `$` of a size that tokens have."""
    cut = F.left if kind == "^" else F.right
    return F.transform(F.filter(tokens, lambda t: F.length(t) >= size), lambda t: F.concat(F.lit(kind), cut(t, F.lit(size))))


def filter_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """url, host, path, rule, verdict and pattern of each distinct url, for rules too many to broadcast.

    rules: rule, verdict, site (boolean), regex and keys (array of string), as site_rule and pattern_rule make them. Urls
    and rules meet by key, in a join that Spark can spread; regular expressions run on what meets. The rules without a
    key, which run on every url, are broadcast after a check of their size.
    """
    urls = pages.select("url").where("url IS NOT NULL").distinct()
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    each = rules.select("rule", "verdict", "site", "regex", F.explode("keys").alias("key"))
    shapes = each.select(F.left("key", F.lit(1)).alias("kind"), F.length("key").alias("n")).where("kind != '='").distinct().orderBy("kind", "n").collect()  # lengths of tokens
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)")))
    features = [F.transform(tokens, lambda t: F.concat(F.lit("="), t)), *(parts_of(tokens, kind, n - 1) for kind, n in shapes)]
    keys = split.select("*", F.explode(F.array_distinct(F.concat(*features))).alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    filed = each.join(counts, "key", "left").groupBy("rule", "verdict", "site", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "key"))["key"].alias("key"))
    met = keys.join(filed, "key").drop("key")
    open_ = rules.where(F.size("keys") == 0)
    if (size := open_.agg(F.sum(F.length("regex") + F.length("rule"))).first()[0] or 0) > MAX_RULE_BYTES:
        raise ValueError(f"the rules without a key take {size} bytes, over {MAX_RULE_BYTES}")
    always = [(r["rule"], r["verdict"], r["site"], r["regex"]) for r in open_.collect()]
    if always:
        row = F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).alias("verdict"), F.lit(c).alias("site"), F.lit(d).alias("regex")) for a, b, c, d in always])
        met = met.unionByName(split.select("*", F.inline(row)))
    text = F.when(F.col("site"), F.concat("host", "path")).otherwise(F.lower("url"))

    @F.pandas_udf("boolean")
    def fits(regexes: pd.Series, texts: pd.Series, anchored: pd.Series) -> pd.Series:
        compiled = {x: re.compile(x) for x in regexes.unique()}
        return pd.Series([bool(compiled[r].match(t) if a else compiled[r].search(t)) for r, t, a in zip(regexes, texts, anchored, strict=True)], dtype=bool)

    best = F.max(F.struct("site", F.length("rule").alias("size"), "rule", "verdict")).alias("best")
    chosen = met.where(fits("regex", text, "site")).groupBy("url").agg(best)
    return split.join(chosen, "url", "left").select(
        "url", "host", "path",
        F.when(F.col("best.site"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.rule")).alias("pattern"),
    )


#: The same with the default rules in DuckDB's SQL.
REPORT_SQL = r"""
WITH split AS (
  SELECT page_id, url, lower(url) AS low,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?www\.example\.com/en/') THEN 'www.example.com/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.com/en/') THEN 'example.com/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/fr/') THEN 'net/fr/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/es/') THEN 'net/es/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?com/') THEN 'com/' END AS rule
  FROM split),
pattern AS (
  SELECT *, CASE
    WHEN rule IS NOT NULL THEN NULL
    WHEN contains(low, 'utm_source=feed') THEN 'utm_source=feed'
    WHEN regexp_matches(low, '//ads\.(?s:.*)/about/') THEN '//ads.*/about/'
    WHEN regexp_matches(low, '/track(?s:.*)/click') THEN '/track*/click'
    WHEN contains(low, '?sessionid=') THEN '?sessionid='
    WHEN contains(low, '/wp-admin/') THEN '/wp-admin/'
    WHEN contains(low, '/banner/') THEN '/banner/'
    WHEN contains(low, '/login?') THEN '/login?'
    WHEN contains(low, '//ads.') THEN '//ads.'
    WHEN contains(low, '/ads/') THEN '/ads/'
    WHEN contains(low, '.exe') THEN '.exe' END AS pattern
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') OR pattern = '//ads.*/about/' OR rule IS NULL AND pattern IS NULL THEN 'allow' ELSE 'block' END AS verdict,
       pattern
FROM pattern
"""
