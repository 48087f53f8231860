"""Operator 2: URL filter by rules and empirical-Bayes host reputation.

Every url gets a verdict.  A short list of (host, path) rules decides first,
the longest fitting rule wins.  Urls without a rule are judged by their host:
labelled page outcomes are counted per host and shrunk through beta-binomial
priors, host -> registered domain -> suffix -> corpus.  A host is blocked when
the lower posterior bound of its bad rate exceeds the allowed rate.

Only DataFrame functions run here.  Html is never read; labels and pages meet
on their id with two narrow columns, and all counts are partial aggregates, so
a host with a third of all pages is a third of a scan and one row afterwards.
Counts per host and the priors of domains are written once in the shared
folder: every prior is fitted on those, and pages are scanned for them once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.sinks.io import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Second-level labels that act as part of a country suffix (``co.uk``).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    """``action`` for ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (both empty for null or without ``://``)."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + F.lit(3)))
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def matched_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule string, action) of the longest fitting rule; nulls without one.

    ``rules`` is configuration, a list of tens, tried longest first."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def with_domain(df: DataFrame) -> DataFrame:
    """Adds ``site`` (host without user and port), ``domain`` and ``suffix``."""
    site = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    df = df.withColumn("site", site)
    parts = F.split("site", "\\.")
    n = F.size(parts)
    second = F.try_element_at(parts, F.lit(-2))
    long_suffix = (n >= 3) & (F.length(F.try_element_at(parts, F.lit(-1))) == 2) & second.isin(*SECOND_LEVEL)
    numeric = F.col("site").rlike("^[0-9.]+$") | F.col("site").contains("[")
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    return df.withColumns({
        "suffix": F.when(numeric, "").when(long_suffix, tail(2)).otherwise(tail(1)),
        "domain": F.when(numeric, F.col("site")).when(long_suffix, tail(3)).otherwise(tail(2)),
    })


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): one outcome per labelled page.  Bad is toxic or low
    quality; conflicting labels of a page count as bad; a label with both
    values null or a null id is no outcome."""
    bad = F.greatest(F.col("toxic"), F.lit(1) - F.col("quality"))
    return (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id"))
            .agg(F.max(bad).alias("bad")).where("bad IS NOT NULL"))


def concentration(children: DataFrame, least: float = 1.0, most: float = 10000.0) -> Column:
    """Moment estimate of the beta prior's strength a + b over ``children``
    (n, bad, mu): the overdispersion that (bad / n - mu)^2 shows beyond
    binomial noise.  Without any, the strongest prior allowed."""
    noise = F.col("mu") * (1 - F.col("mu"))
    seen = children.where("n > 0")
    excess = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), 2) - noise)
    room = F.sum(noise * (F.col("n") - 1))
    rho = F.when(room > 0, excess / room)
    k = F.when(rho > 0, 1 / rho - 1).otherwise(most)
    return seen.agg(F.coalesce(F.least(F.greatest(k, F.lit(least)), F.lit(most)), F.lit(most)).alias("k")).scalar()


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): n, bad, the posterior
    mean ``bad_rate`` and its lower bound ``bad_lower`` (mean - z * sd)."""
    sites = (pages.join(outcomes, "page_id", "left").groupBy("host")
             .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    sites = materialize(with_domain(sites), "host-counts")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Laplace's rule at the root: defined even without a single label
    root = suffixes.agg(F.coalesce((F.sum("bad") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("mu")).scalar()

    def shrunk(level: DataFrame) -> DataFrame:
        k = concentration(level)
        return level.withColumn("k", k).withColumn(
            "rate", (F.col("k") * F.col("mu") + F.col("bad")) / (F.col("k") + F.col("n")))

    up = shrunk(suffixes.withColumn("mu", root)).select("suffix", F.col("rate").alias("mu"))
    mid = materialize(shrunk(domains.join(up, "suffix")).select("domain", "suffix", F.col("rate").alias("mu")), "domain-rates")
    out = shrunk(sites.join(mid, ["domain", "suffix"]))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("k") + F.col("n") + 1))
    return out.select("host", "n", "bad", F.col("rate").alias("bad_rate"),
                      F.greatest(F.col("rate") - z * sd, F.lit(0.0)).alias("bad_lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES,
               max_bad_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url).

    Returns page_id, host, path, rule, verdict, host_labelled, bad_rate,
    bad_lower.  Null and malformed urls have an empty host and path, match no
    rule and are judged as one host "".  Repeated rows are judged alike, once
    each.  Pages without labels, and an empty ``labels``, leave the prior
    alone, which allows.  Other columns of the inputs are not looked at."""
    urls = split_url(pages.select("page_id", "url")).drop("url")
    scores = host_reputation(urls.select("page_id", "host"), page_outcomes(labels), z)
    rule, action = matched_rule(rules, F.col("host"), F.col("path"))
    judged = F.when(F.col("bad_lower") > max_bad_rate, "block").otherwise("allow")
    return (urls.withColumns({"rule": rule, "action": action}).join(scores, "host", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("action", judged).alias("verdict"),
                    F.col("n").alias("host_labelled"), "bad_rate", "bad_lower"))
