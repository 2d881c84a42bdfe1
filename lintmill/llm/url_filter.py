"""URL filter by rules and by empirical-Bayes host reputation. [native]

A rule list labels some pages. Labelled outcomes (blocked or allowed) are
summed by host and shrunk down a chain of beta-binomial priors: all pages,
public suffix, registered domain, host. The prior of a level has its parent's
posterior mean; its weight (in pages) is estimated by moments from the spread
of the children's rates. A page without a rule is blocked if the lower bound of
its host's posterior block rate reaches the threshold; a host without labels
has its domain's posterior, and so on upwards.

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule. Repeated rows are judged each by itself and all count as
outcomes. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, fresh, lower_ascii, written

#: Second-level labels that act as part of the suffix below a country code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Weight in pages of a prior whose children don't spread, and the least weight.
WEIGHTS = (1.0, 1000.0)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block example.com/de/``, longest first."""
    rules = []
    for line in lines:
        verdict, place = line.split(None, 1)
        host, slash, rest = place.partition("/")
        rules.append(Rule(verdict, host, slash + rest))
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (text, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in reversed(rules):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """The last label, with a second-level label before a country code."""
    second = "|".join(SECOND_LEVEL)
    return F.coalesce(
        F.nullif(F.regexp_extract(host, rf"(?:^|\.)((?:{second})\.[a-z]{{2}})$", 1), F.lit("")), F.substring_index(host, ".", -1)
    )


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    labels = F.size(F.split(suffix_of(host), r"\.")) + 1
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) <= labels, host).otherwise(F.array_join(F.slice(parts, -labels, labels), "."))


def _shrunk(joined: DataFrame, key: str) -> DataFrame:
    """Posterior (alpha, beta) of each key of a level with labels; ``prior`` is its parent's mean.

    The prior's weight is (mean(1-mean) - s) / s, where s is the variance of the
    children's rates about their parents' means beyond what sampling explains.
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    spread = joined.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("squares"),
        F.sum(noise).alias("sampling"),
        F.sum(F.col("n") * noise).alias("room"),
        F.sum("n").alias("pages"),
        F.count(F.lit(1)).alias("children"),
    )
    excess = F.greatest(F.col("squares") - F.col("sampling"), F.lit(0.0)) / F.greatest(F.col("pages") - F.col("children"), F.lit(1))
    room = F.col("room") / F.col("pages")
    weight = F.when(excess <= 0, F.lit(WEIGHTS[1])).otherwise(F.least(F.greatest(room / excess - 1, F.lit(WEIGHTS[0])), F.lit(WEIGHTS[1])))
    weight = F.lit(spread.select(weight).first()[0] or WEIGHTS[1])  # one number for the level
    return (
        joined.withColumn("alpha", F.col("bad") + weight * F.col("prior"))
        .withColumn("beta", F.col("n") - F.col("bad") + weight * (1 - F.col("prior")))
        .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        .select(*[c for c in dict.fromkeys((key, "suffix")) if c in joined.columns], "alpha", "beta", "mean")
    )


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of the block rate of every host of ``outcomes(host, bad)``.

    ``bad`` is 1, 0 or null (no label). Returns host, n (labels), alpha, beta.
    """
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
        .withColumn("suffix", suffix_of(F.col("host")))
        .withColumn("domain", domain_of(F.col("host")))
    )
    hosts = written(hosts, "hosts")
    named = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(named, "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = suffixes.agg((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).first()[0] or 0.5  # one number

    def under(level: DataFrame, parent: DataFrame, on: str) -> DataFrame:
        return level.join(parent.select(on, F.col("mean").alias("prior")), on)

    def chained(level: DataFrame, key: str) -> DataFrame:
        """Labelled keys have their own posterior, the others their parent's mean."""
        own = _shrunk(level.where(F.col("n") > 0), key)
        rest = level.where(F.col("n") == 0).withColumns({"alpha": F.col("prior"), "beta": 1 - F.col("prior"), "mean": F.col("prior")})
        return own.unionByName(rest.select(*own.columns))

    by_suffix = written(chained(suffixes.withColumn("prior", F.lit(overall)), "suffix"), "suffix_rates")
    by_domain = written(chained(under(domains, by_suffix, "suffix"), "domain").drop("suffix"), "domain_rates")
    return chained(under(hosts, by_domain, "domain"), "host").select("host", "alpha", "beta", "mean")


def lower_bound(alpha: Column, beta: Column, z: float) -> Column:
    """Posterior mean less z posterior standard deviations."""
    total = alpha + beta
    mean = alpha / total
    return mean - z * F.sqrt(mean * (1 - mean) / (total + 1))


def judge_urls(pages: DataFrame, rules: list[str], threshold: float = 0.5, z: float = 1.64, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    Only hosts and counts are shuffled. Blocked hosts are joined back from a
    written table: by broadcast if its measured size allows, else by a shuffle
    whose hot hosts adaptive execution splits.
    """
    parsed = parse_rules(rules)
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    # A column of that name that came with the pages gives way to ours.
    placed = pages.drop(*clash).select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, name = fresh(placed, "_rule"), fresh(placed, "_host")
    placed = placed.withColumn(rule, matching_rule(F.col("host"), F.col("path"), parsed))
    bad = F.when(F.col(rule).isNotNull(), (F.col(rule)["verdict"] == "block").cast("int"))
    rates = reputation(placed.select("host", bad.alias("bad")))
    blocked = written(rates.where(lower_bound(F.col("alpha"), F.col("beta"), z) >= threshold).select(F.col("host").alias(name)), "blocked_hosts")
    blocked = broadcast_if_small(blocked, F.octet_length(name) + 32)
    out = placed.join(blocked, F.col("host") == F.col(name), "left")
    verdict = F.coalesce(F.col(rule)["verdict"], F.when(F.col(name).isNotNull(), "block").otherwise("allow"))
    return out.select(*[c for c in placed.columns if c != rule], F.col(rule)["text"].alias("rule"), verdict.alias("verdict"))
