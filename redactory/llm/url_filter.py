"""Host reputation: labelled outcomes shrunk from suffix to registered domain to host.

Every level's rate has a beta prior centred on the level above: all pages, suffix, registered
domain, host.  The strength of each prior is fitted to the data by the method of moments: the
more the groups of a level differ beyond chance, the weaker the pull.  A page is blocked when
even the upper posterior bound of its host's rate of good pages is below the wanted rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.salting import lookup_join
from ..plans.shared import written
from .common import LOWER, UPPER

# Suffixes of two labels under which names are registered: a fixed, short list.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp",
                "com.br", "com.cn", "co.in", "co.za", "com.mx", "com.tr", "co.kr", "com.sg", "com.ar")
WANTED_RATE = 0.5
Z = 1.645              # one-sided 95 %
WEAKEST, STRONGEST = 1.0, 1e6   # bounds of a prior's strength, in pages


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label before it; a bare suffix is its own domain."""
    return F.when(F.substring_index(host, ".", -2).isin(*SECOND_LEVEL), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.

    A rule is ``host/path``; it fits its host and all subdomains where the path starts with its path.
    """
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def strength(groups: DataFrame) -> float:
    """Prior strength of groups ``(n, good, up)`` around their prior means ``up``.

    Moments: E[(good - n m)^2] = n m (1 - m) (1 + (n - 1) rho), rho = 1 / (1 + strength).
    """
    m = F.col("up")
    chance = F.col("n") * m * (1 - m)
    off = F.col("good") - F.col("n") * m
    row = groups.agg(F.sum(off * off - chance).alias("excess"), F.sum(chance * (F.col("n") - 1)).alias("scale")).first()
    if not row["scale"] or row["scale"] <= 0 or row["excess"] <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, row["scale"] / row["excess"] - 1))


def shrunk(with_prior: DataFrame, s: float) -> DataFrame:
    return with_prior.withColumn("rate", (F.col("good") + s * F.col("up")) / (F.col("n") + s))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Outcomes ``(host, good 0/1, null for no label)`` to ``(host, n, good, rate, low, high)``.

    ``low`` and ``high`` bound the host's rate of good pages: mean and ``z`` standard deviations of
    its beta posterior, held in 0..1.  Hosts without a labelled page take their domain's rate, at the
    strength of the host prior.  Without any label every rate is one half.  Three strengths and one
    rate are all that reaches the driver.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = written(hosts.select("host", domain_of(F.col("host")).alias("domain"),
                                 suffix_of(F.col("host")).alias("suffix"), "n", "good"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    level = suffixes.withColumn("up", F.lit(((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)))
    above = shrunk(level, strength(level)).select("suffix", F.col("rate").alias("up"))
    level = domains.join(above, "suffix")
    above = shrunk(level, strength(level)).select("domain", "suffix", F.col("rate").alias("up"))
    level = hosts.join(above, ["domain", "suffix"])
    s = strength(level)
    by_host = shrunk(level, s)
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + s + 1))
    return by_host.select("host", "n", "good", "rate",
                          F.greatest(F.lit(0.0), F.col("rate") - z * spread).alias("low"),
                          F.least(F.lit(1.0), F.col("rate") + z * spread).alias("high"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (),
                wanted_rate: float = WANTED_RATE, z: float = Z) -> DataFrame:
    """``pages(page_id, url)`` and outcomes ``labels(page_id, good)`` to
    ``(page_id, host, path, rule, verdict, rate, low, high)``, one row per page.

    ``rules`` are (``host/path``, allow or block).  A null url or one without ``://`` has an empty
    host and path and is judged with all others like it.  Labels with a null id or outcome count
    nowhere; of several labels of a page all count.  Repeated pages are judged each, and a page counts
    with its labels once.  Other columns are ignored; an empty table gives no rows.
    """
    seen = pages.select("page_id", "url")
    placed = seen.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    once = placed.where("page_id IS NOT NULL").groupBy("page_id").agg(F.min("host").alias("host"))
    known = labels.select(F.col("page_id").alias("_id"), F.col("good").cast("long").alias("good")).where("good IS NOT NULL")
    outcomes = placed.select("host", F.lit(None).cast("long").alias("good")).unionByName(
        once.join(known, F.col("page_id") == F.col("_id")).select("host", "good"))
    reputation = host_reputation(outcomes, z).select("host", "rate", "low", "high")
    judged = lookup_join(placed, reputation, "host", ["page_id", "path"], "left")
    rule, decision = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("high") < wanted_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(decision, own).alias("verdict"),
                         "rate", "low", "high")
