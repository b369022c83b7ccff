"""URL filters: host rules, then an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.store import keep

#: Rules of the query: host and path, and what they say.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Suffixes of two labels under which names are registered: a default, to be replaced by the public suffix list's.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "com.mx")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more; the host itself if it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: the url's host is the rule's or below it, and its path begins with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, rule).otherwise(out)
    return out


def _posteriors(nodes: DataFrame) -> DataFrame:
    """nodes (.., n, y, m) with mean and strength of each node's posterior at one level.

    The prior is a beta distribution round the parent's posterior mean m, whose
    strength k comes from all nodes by moments: under a beta-binomial, sum of
    n (y/n - m)^2 / (m (1 - m)) has the mean sum of (1 + (n - 1) r) with
    r = 1 / (k + 1), r held to [0.001, 0.5]. The table is written, so that the level
    below reads it, and the one number r comes from its sums.
    """
    nodes = keep(nodes, "nodes")
    n, y, m = F.col("n"), F.col("y"), F.col("m")
    seen = F.when(n > 0, n * F.pow(y / F.when(n > 0, n) - m, 2) / (m * (1 - m)))
    r = nodes.agg(F.sum(seen).alias("q"), F.count_if(n > 0).alias("g"), F.sum(F.greatest(n - 1, F.lit(0))).alias("d"))
    r = r.select(F.round(F.coalesce(F.least(F.greatest((F.col("q") - F.col("g")) / F.when(F.col("d") > 0, F.col("d")), F.lit(0.001)), F.lit(0.5)), F.lit(0.5)), 6)).first()[0]
    k = F.lit(1.0) / F.lit(float(r)) - 1
    return nodes.withColumn("mean", (k * m + y) / (k + n)).withColumn("strength", k + n)


def reputations(hosts: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, mean, strength, lower): posterior of each host from hosts (host, n, y) of labelled pages and good ones, shrunk to its domain, suffix and the whole."""
    host = F.col("host")
    hosts = keep(hosts.select("host", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), "n", "y"), "hosts")
    domains = keep(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("y").alias("y")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    whole = domains.agg((F.coalesce(F.sum("y"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]
    top = _posteriors(tops.withColumn("m", F.lit(float(whole))))
    middle = _posteriors(domains.join(top.select("suffix", F.col("mean").alias("m")), "suffix"))
    out = _posteriors(hosts.join(middle.select("domain", F.col("mean").alias("m")), "domain"))
    mean, strength = F.col("mean"), F.col("strength")
    return out.select("host", "n", "mean", "strength", (mean - z * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("lower"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good) of the pages whose url ends in the number of a labelled document: good quality and not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    numbered = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    return numbered.join(good, "doc_id").select("page_id", "good")


def filter_urls(pages: DataFrame, known: DataFrame, threshold: float = 0.5, z: float = 1.645, rules=RULES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, mean, lower) for each row of pages (page_id, url).

    known is (page_id, good 0/1). A fitting rule decides; else the page is allowed if
    the lower bound of its host's posterior is the threshold or more. Hosts without
    labelled pages have the posterior of their domain; null urls and those without
    "://" have an empty host, a host of its own. Rows that repeat are judged each,
    and count once for each label; without labels the prior (0.5) decides. suffixes
    are those of two labels under which names are registered; all others have one.
    """
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = known.where("page_id is not null and good is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.min("good").alias("good"))
    hosts = at.join(labelled, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("y"))
    found = reputations(hosts, z, suffixes)
    out = at.join(found, "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("rule").isin(*[r for r, v in rules if v == "block"]), "block").otherwise("allow")
    own = F.when(F.col("lower") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), by_rule).otherwise(own).alias("verdict"), F.col("n").alias("n_labelled"), "mean", "lower")
