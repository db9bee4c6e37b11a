"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host; a host's bad rate is shrunk to that
of its registered domain, this to its public suffix, and this to all pages, by
beta-binomial priors whose strength comes from the outcomes themselves (method
of moments: how much groups differ beyond binomial noise). A page is blocked
where the lower posterior bound of its host's bad rate reaches `block_rate`.
DataFrame functions only; counts are aggregated per host before anything joins.

Defined cases: a null url or one without "://" has empty host and path, and the
empty host is one host as any other; outcomes that are null or for unknown pages
count for nothing; without any outcome the overall bad rate is one half; a page
id with several outcomes counts them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, verdict, rule) of the longest rule that fits, else null. rules: (verdict, "host/path"), a short configured list; of equally long ones block wins."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        here = (host == name) | host.endswith("." + name)
        fits.append(F.when(here & path.startswith(slash + rest), F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    return F.array_max(F.array(*fits)) if fits else none


def suffix_and_domain(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Public suffix (one of `suffixes`, else the last label) and registered domain (one label more); a port and a dot at the end are no part of them, and a host of numbers alone is its own domain, without a suffix."""
    host = F.regexp_replace(host, r"\.?(:\d*)?$", "")
    numbers = host.rlike(r"^(\d+\.)+\d+$")
    last = "|".join([*(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True)), "[^.]+"])
    suffix = F.regexp_extract(host, rf"(?:^|\.)({last})$", 1)
    domain = F.regexp_extract(host, rf"(?:^|\.)([^.]+\.(?:{last}))$", 1)
    return F.when(numbers, "").otherwise(suffix), F.when(numbers | (domain == ""), host).otherwise(domain)


def _strength(level: DataFrame) -> DataFrame:
    """One row: prior strength from (n, bad, prior). Of E[n (rate - prior)^2 / (prior (1 - prior))] = 1 + (n - 1) rho, solved for rho = 1 / (strength + 1)."""
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))))
    groups, total = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum("n")
    rho = F.when(total > groups, (spread - groups) / (total - groups)).otherwise(F.lit(0.5))
    return level.agg((1 / F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(rho, F.lit(0.5)))) - 1).alias("strength"))


def host_reputation(hosts: DataFrame, suffixes: Sequence[str] = (), z: float = 1.0) -> DataFrame:
    """hosts (host, n, bad: counts of outcomes) -> host, n, bad_rate (posterior mean), bad_bound (mean less z standard deviations)."""
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = tops.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))

    def shrunk(level: DataFrame, keep: str) -> DataFrame:
        return level.withColumn("strength", _strength(level).scalar()).select(
            keep, ((F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))).alias("prior")
        )

    tops = shrunk(tops.withColumn("prior", overall.scalar()), "suffix")
    domains = shrunk(domains.join(tops, "suffix"), "domain")
    hosts = hosts.join(domains, "domain")
    hosts = hosts.withColumn("strength", _strength(hosts).scalar())
    a = F.col("bad") + F.col("strength") * F.col("prior")
    size = F.col("n") + F.col("strength")
    rate = a / size
    return hosts.select("host", "n", rate.alias("bad_rate"), (rate - z * F.sqrt(rate * (1 - rate) / (size + 1))).alias("bad_bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame | None,
    rules: Sequence[tuple[str, str]],
    suffixes: Sequence[str] = (),
    z: float = 1.0,
    block_rate: float = 0.5,
) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, n_outcomes, bad_bound.

    outcomes (page_id, bad 0/1) are the labelled pages. With None, the pages that
    a rule judges are the labelled ones, each with its rule's verdict.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        seen = judged.select("host", (F.col("_best.verdict") == "block").cast("int").alias("bad"))
    else:
        known = outcomes.where("page_id is not null and bad is not null").select("page_id", F.col("bad").cast("int").alias("bad"))
        seen = judged.select("page_id", "host").join(known, "page_id", "left").select("host", "bad")
    counts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    verdicts = host_reputation(cut(counts), suffixes, z)  # read for each level and its strength
    learned = F.when(F.col("bad_bound") >= block_rate, "block").otherwise("allow")
    return judged.join(verdicts, "host").select(
        "page_id",
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), learned).alias("verdict"),
        F.col("n").alias("n_outcomes"),
        "bad_bound",
    )
