"""Host reputation: beta-binomial shrinkage from host to registered domain to suffix.

Native column expressions only. Labelled page outcomes are counted per host; each level's prior
is the level above it, with a strength estimated from the counts by moments, and a host is
blocked when even the upper posterior bound of its share of good pages is below a cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.sizing import broadcast_if_small
from stageloom.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOUND_Z = 1.645
CUT = 0.5
ADDRESS = "[address]"  # the suffix of hosts that are IP addresses
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Host after the first ://, A-Z lower-cased; empty without one or for NULL."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without :// or for NULL."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _without_port(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")


def _longest_suffix(bare: Column, suffixes: Sequence[str], otherwise: Column, more: int) -> Column:
    """The last labels of ``bare`` that are its longest suffix of several labels, and ``more`` labels before them."""
    by_labels: dict[int, list[str]] = {}
    for s in sorted({s.translate(str.maketrans(UPPER, LOWER)).strip(".") for s in suffixes}):
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    found = otherwise
    for labels in sorted(by_labels.keys() - {1}):
        fits = F.substring_index(bare, ".", -labels).isin(by_labels[labels])
        found = F.when(fits, F.substring_index(bare, ".", -labels - more)).otherwise(found)
    return found


def registered_domain(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of ``suffixes`` below which the host stands and the label before it, without port.

    Below none of them the last two labels; a host with fewer labels and an address are their own domain.
    """
    bare = _without_port(host)
    pair = F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)
    return F.when(_is_address(bare), bare).otherwise(_longest_suffix(bare, suffixes, F.when(pair == "", bare).otherwise(pair), 1))


def host_suffix(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of ``suffixes``, or the last label, without port; all addresses share ADDRESS."""
    bare = _without_port(host)
    return F.when(_is_address(bare), F.lit(ADDRESS)).otherwise(_longest_suffix(bare, suffixes, F.regexp_extract(bare, r"([^.]+)$", 1), 0))


def matching_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else NULL; of equal lengths the first."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(good: Column, n: Column) -> Column:
    """Beta-binomial prior strength of the groups of one level, by moments, kept within its limits."""
    total, groups, p = F.sum(n), F.count(F.when(n > 0, 1)), F.try_divide(F.sum(good), F.sum(n))
    spread = F.sum(F.try_divide(good * good, n)) - total * p * p
    noise = p * (1 - p)
    rho = F.try_divide(spread - noise * (groups - 1), noise * (total - F.try_divide(F.sum(n * n), total) - (groups - 1)))
    strength = F.when(rho > 0, F.try_divide(F.lit(1.0), rho) - 1).otherwise(MOST_STRENGTH)
    return F.coalesce(F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH))


def host_reputation(urls: DataFrame, outcomes: DataFrame, z: float = BOUND_Z, suffixes: Sequence[str] = ()) -> DataFrame:
    """One row per host of ``urls`` (url): labelled and good pages, posterior mean and bounds.

    ``outcomes`` has (url, good): one row per labelled page, good 1 or 0; a row with a NULL good
    does not count and a repeated row counts again. Hosts without outcomes get their domain's mean,
    or the suffix's, or the overall one; without any outcome that is 0.5. ``suffixes`` are those of several
    labels (co.uk) below which domains are registered; elsewhere the last label is the suffix.
    """
    known = outcomes.where(F.col("good").isNotNull()).groupBy(url_host(F.col("url")).alias("host"))
    known = known.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    hosts = urls.select(url_host(F.col("url")).alias("host")).distinct().join(known, "host", "full")
    hosts = materialise(
        hosts.select(
            "host",
            registered_domain(F.col("host"), suffixes).alias("domain"),
            host_suffix(F.col("host"), suffixes).alias("suffix"),
            F.coalesce("n", F.lit(0.0)).alias("n"),
            F.coalesce("good", F.lit(0.0)).alias("good"),
        ),
        "hosts",
    )
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = hosts.groupBy("suffix").agg(*counts)
    share = (F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)
    strength = _strength(F.col("good"), F.col("n"))
    measured = hosts.agg(F.lit("overall").alias("level"), share.alias("value"))
    for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes)):
        measured = measured.unionByName(level.agg(F.lit(name).alias("level"), strength.alias("value")))
    prior = dict(measured.collect())  # four rows
    shrunk = lambda strength, prior: (strength * prior + F.col("good")) / (strength + F.col("n"))
    suffixes = suffixes.select("suffix", shrunk(F.lit(prior["suffix"]), F.lit(prior["overall"])).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", shrunk(F.lit(prior["domain"]), F.col("suffix_mean")).alias("domain_mean")
    )
    a = F.lit(prior["host"]) * F.col("domain_mean") + F.col("good")
    b = F.lit(prior["host"]) * (1 - F.col("domain_mean")) + F.col("n") - F.col("good")
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, "domain").select(
        "host",
        F.col("n").cast("long").alias("n_labelled"),
        F.col("good").cast("long").alias("n_good"),
        mean.alias("mean"),
        (mean - z * deviation).alias("lower"),
        (mean + z * deviation).alias("upper"),
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = BOUND_Z,
    cut: float = CUT,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """Every page with host, path, the longest fitting rule and the verdict.

    The rule's verdict holds where one fits; else the host is blocked when the upper posterior bound
    of its share of good pages is below ``cut``; ``suffixes`` as in host_reputation. A NULL url has an empty host and path and is
    judged like any other host; repeated rows stay; an empty table gives no rows.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    hosts = materialise(host_reputation(urls.select("url"), outcomes, z, suffixes), "reputation")
    urls = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("upper") < cut, F.lit("block")).otherwise(F.lit("allow"))
    return (
        urls.join(broadcast_if_small(hosts), "host", "left")
        .withColumn("rule", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("rule.name").alias("rule"),
            F.coalesce(F.col("rule.verdict"), by_method).alias("verdict"),
            "n_labelled",
            "n_good",
            F.round("mean", 6).alias("mean"),
            F.round("upper", 6).alias("upper"),
        )
    )
