"""Operator 4, URL filters by pattern rules under a literal-token index.

Native: DataFrame functions only. A rule is a regular expression with the
literal tokens (runs of a-z and 0-9, whole) that any URL it matches must
hold. Each rule is filed under its rarest token, by the counts over all
distinct URLs; a URL's tokens fetch their candidate rules by an equi-join,
and only those run their expressions. A rule without tokens is filed under
the empty token, which every URL has.

Work is per distinct URL, so repeated URLs cost one evaluation. Rules come
from the caller's memory; up to ``BROADCAST_BYTES`` they are broadcast, and
beyond it joined by shuffle with salted tokens, so that a token held by a
third of all URLs is spread over ``SALTS`` keys.

Defined results: null URLs and those without "://" have empty host and path
and no site rule; ties between site rules of equal length go to the rule
that sorts last; an empty rule list allows everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import LOWER, UPPER, ascii_lower, fresh, q

BROADCAST_BYTES, SALTS = 8 << 20, 32


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``regex`` runs on host + path for a site rule
    (whose longest match decides) and else on the URL with A-Z lower-cased."""
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(action: str, rule: str) -> Rule:
    """A rule of a host and a path prefix, which fits subdomains too."""
    host, slash, path = rule.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<![a-z0-9])[a-z0-9]+(?![a-z0-9]|$)", (slash + path).translate(str.maketrans(UPPER, LOWER)))
    return Rule(rule, action, r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + slash + path), tuple(whole), True)


def word_rule(action: str, word: str) -> Rule:
    """A rule of one whole token anywhere in the URL."""
    return Rule(f"~{word}", action, rf"(?<![a-z0-9]){word}(?![a-z0-9])", (word,))


def phrase_rule(action: str, phrase: str) -> Rule:
    """A rule of several tokens with the signs between them, filed under the
    rarest of them."""
    between = re.sub(r"([^a-z0-9])", r"\\\1", phrase)
    return Rule(f"~{phrase}", action, rf"(?<![a-z0-9]){between}(?![a-z0-9])", tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", phrase))))


#: Parts of URLs of advertising, tracking, sign-in, shop and machine pages.
PHRASES = (
    "ad/click", "ads/banner", "ad-server", "adservice.google", "doubleclick.net", "googlesyndication.com", "taboola.com", "outbrain.com",
    "tracking/pixel", "pixel.gif", "utm_source=ad", "wp-login.php", "wp-admin", "cgi-bin", "user/login", "user/register", "account/login",
    "account/create", "members/sign-up", "lost-password", "shopping-cart", "add-to-cart", "my-account", "cart/checkout", "order/confirm",
    "share/email", "email-a-friend", "print/version", "comment/reply", "feed/rss", "search/results", "tag/page", "online-casino", "adult/video",
)
#: The method's own patterns, for URLs without a site rule.
PATTERNS = (
    *[phrase_rule("block", p) for p in PHRASES],
    *[word_rule("block", w) for w in ("ad", "ads", "adserver", "banner", "tracker", "casino", "porn", "xxx", "login", "signin", "cart", "checkout")],
    Rule("~pixel-image", "block", r"/pixel[^/]*\.(gif|png)", ()),
    *[Rule("~click-redirect", "block", rf"[?&]{w}=http", (w,)) for w in ("url", "redirect", "goto")],
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, whole, 1)), F.regexp_extract(u, whole, 2)


def url_tokens(url: Column) -> Column:
    """Distinct tokens, with the empty one."""
    return F.array_union(F.split(ascii_lower(url), r"[^a-z0-9]+"), F.array(F.lit("")))


def rule_index(rules, urls: DataFrame, url: str) -> DataFrame:
    """(token, name, action, regex, site): every rule under the one of its
    tokens that the fewest distinct URLs hold."""
    spark = urls.sparkSession
    rows = [(r.name, r.action, r.regex, r.site, t) for r in rules for t in (r.tokens or ("",))]
    table = spark.createDataFrame(rows, "name string, action string, regex string, site boolean, token string")
    wanted = F.broadcast(table.select("token").distinct()) if rule_bytes(rules) <= BROADCAST_BYTES else table.select("token").distinct()
    counts = urls.select(F.explode(url_tokens(q(url))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (table.join(counts, "token", "left").groupBy("name", "action", "regex", "site")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))


def rule_bytes(rules) -> int:
    return sum(len(r.regex) + len(r.name) + sum(map(len, r.tokens)) + 64 for r in rules)


def url_verdicts(pages: DataFrame, rules, url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``pattern`` (the first of
    the method's patterns that matched); clashing columns are replaced."""
    u, = fresh(pages, "url")
    urls = pages.select(q(url).alias(u)).filter(q(u).isNotNull()).distinct()
    index = rule_index(rules, urls, u)
    host, path = url_parts(q(u))
    probes = urls.select(u, F.concat(host, path).alias("at"), F.explode(url_tokens(q(u))).alias("token"))
    if rule_bytes(rules) <= broadcast_bytes:
        fetched = probes.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fetched = probes.withColumn("salt", F.pmod(F.xxhash64(u), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    hits = fetched.filter(F.rlike(F.when(F.col("site"), F.col("at")).otherwise(F.translate(u, UPPER, LOWER)), F.col("regex")))
    best = F.max(F.when(F.col("site"), F.struct(F.length("name").alias("size"), "name", "action")))
    judged = hits.groupBy(u).agg(
        best["name"].alias("rule"), best["action"].alias("site_action"),
        F.min(F.when(~F.col("site") & (F.col("action") == "block"), F.col("name"))).alias("pattern"))
    out = ("host", "path", "rule", "verdict", "pattern")
    kept = [c for c in pages.columns if c.lower() not in out]
    judged = judged.select(F.struct("rule", "site_action", "pattern").alias("j"), u)
    joined = pages.select(*[q(c) for c in kept]).join(judged, q(url) == q(u), "left")
    verdict = F.coalesce("j.site_action", F.when(F.col("j.pattern").isNotNull(), F.lit("block")), F.lit("allow"))
    return joined.select(*[q(c) for c in kept], *[c.alias(n) for c, n in zip(
        (*url_parts(q(url)), F.col("j.rule"), verdict, F.col("j.pattern")), out)])
