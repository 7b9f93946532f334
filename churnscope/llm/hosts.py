"""URL filter with empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes are counted per host, registered domain and suffix.  At
each level the groups are shrunk towards their parent's mean with a
beta-binomial prior whose strength comes from the spread of the groups' rates
(method of moments).  A host's posterior is a beta distribution around its
domain's mean; a page is allowed if the posterior mean less ``Z`` standard
deviations reaches ``BOUND``.  Hosts without labels get their domain's prior.
Rules come first: the longest rule that fits host and path decides.

Only three prior strengths and the overall rate (one row) reach the driver.

Defined cases: a null url, or one without ``://``, has empty host and path and
is judged as the host ``''``; labels of unknown pages, and null labels, are
ignored; without any label the overall rate is 1/2; repeated pages are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BOUND = 0.6
Z = 1.64
#: Second-level labels that, before a two-letter country code, belong to the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (user part and port put aside)."""
    bare = F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", "")
    address = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    long_suffix = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    suffix = F.when(long_suffix, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(long_suffix, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule as text, and its action; null where none fits."""
    rule = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    return rule, action


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength of ``groups(n, good, <mean>)`` by the method of moments."""
    m = F.col(mean)
    r = (
        groups.filter("n > 0")
        .agg(
            F.sum((F.col("good") / F.col("n") - m) ** 2 * F.col("n") / F.greatest(m * (1 - m), F.lit(1e-6))).alias("s"),
            F.sum("n").alias("n"),
            F.sum(F.col("n").cast("double") ** 2).alias("nn"),
            F.count(F.lit(1)).alias("k"),
        )
        .first()
    )
    if not r["k"] or r["k"] < 2:
        return 10.0
    room = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    rho = (r["s"] - (r["k"] - 1)) / room if room > 0 else 0.0
    return 1 / min(max(rho, 1e-3), 0.9) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, good, mean, lower`` of every host; ``outcomes(page_id, good)`` labels pages."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"))
    labels = outcomes.filter("page_id IS NOT NULL AND good IS NOT NULL").select("page_id", F.col("good").cast("long").alias("good"))
    seen = own.join(labels, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    domain, suffix = _levels(F.col("host"))
    hosts = (
        own.groupBy("host")
        .agg(F.count(F.lit(1)).alias("pages"))
        .join(seen, "host", "left")
        .select("host", domain.alias("domain"), suffix.alias("suffix"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good")])
    )
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    rate = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5

    def shrunk(groups: DataFrame) -> DataFrame:
        k = _strength(groups, "prior")
        return groups.withColumn("k", F.lit(k)).withColumn("mean", (F.col("good") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))

    suffixes = shrunk(suffixes.withColumn("prior", F.lit(rate)))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]))
    size = F.col("n") + F.col("k")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") - Z * spread).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, bound: float = BOUND) -> DataFrame:
    """``page_id, host, path, rule, lower, verdict`` of every page."""
    fame = host_reputation(pages, outcomes).select(F.col("host").alias("_h"), "lower")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_column(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") >= bound, F.lit("allow")).otherwise(F.lit("block"))
    return own.join(fame, F.col("host") == F.col("_h")).select(
        "page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), "lower",
        (method if action is None else F.coalesce(action, method)).alias("verdict"),
    )
