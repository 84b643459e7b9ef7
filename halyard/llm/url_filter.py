"""URL filters: given rules first, then the reputation of hosts by empirical Bayes.

Labelled page outcomes are counted by host. A host's share of bad pages is shrunk to its registered domain's, that one to its public suffix's, that
one to the share of all: each level has a beta prior around the posterior mean of the level above, as strong as the spread among the level's groups says
(moments of the beta-binomial distribution), but no surer than that mean itself is: the variances add. A host is blocked where the lower posterior bound of its bad share is above a limit, so hosts of few
or no labels are blocked by their domain's record only.

Counts are summed before every shuffle; outcomes are joined to (host, key) pairs, not pages. Hosts that hold 1/10,000 of all pages each are
broadcast (10,000 at most), the others' verdicts meet their pages in a shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and a verdict from the empty host's own record; urls of any length are taken whole;
copies are judged one by one; a repeated outcome key counts once, bad if any of its rows is bad; null keys and null outcomes count nowhere; without outcomes all hosts are allowed; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .lookups import look_up

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``where`` is a host and a path, such as ``example.net/en/``; it holds for the host and its subdomains."""

    verdict: str
    where: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.where.partition("/")[2]


@dataclass(frozen=True)
class Reputation:
    """A host is blocked where its bad share's posterior mean less ``z`` standard deviations is above ``limit``. Priors count as at least ``weakest`` and at
    most ``strongest`` pages. ``suffixes``: public suffixes of two labels; all other suffixes have one."""

    limit: float = 0.5
    z: float = 1.645
    weakest: float = 1.0
    strongest: float = 1e6
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ac.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr", "com.tr", "com.ar")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (by host and path together, then by host, then allow before block), as a struct of where and verdict; null if none."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.where), len(r.host), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.where).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column, suffixes: tuple[str, ...]) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...]) -> Column:
    """The suffix and one label more; a host that has no more is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _level(groups: DataFrame, prior: Reputation) -> DataFrame:
    """Adds ``share`` (posterior mean) and ``sure`` (pages behind it, the prior's included) to groups of (n, bad, mean, behind); ``mean`` and the pages behind it
    are from the level above.

    The prior's strength is one number a level: squared misses, in units of binomial variance, exceed n by n(n-1) * rho, rho = 1 / (strength + 1).
    """
    miss = F.pow(F.col("bad") - F.col("n") * F.col("mean"), F.lit(2.0)) / (F.col("mean") * (1 - F.col("mean")))
    rho = F.try_divide(F.sum(miss - F.col("n")), F.sum(F.col("n").cast("double") * (F.col("n") - 1)))
    strength = F.when(rho > 0, F.least(F.greatest(F.try_divide(F.lit(1.0), rho) - 1, F.lit(prior.weakest)), F.lit(prior.strongest))).otherwise(F.lit(prior.strongest))
    one = groups.agg(F.coalesce(strength, F.lit(prior.strongest)).alias("strength"))  # one row
    own = (F.col("strength") + 1) * (F.col("behind") + 1) / (F.col("strength") + F.col("behind") + 2) - 1
    with_prior = groups.join(F.broadcast(one), F.lit(True)).withColumn("own", own)
    sure = F.col("n") + F.col("own")
    return with_prior.select(*groups.columns, ((F.col("bad") + F.col("own") * F.col("mean")) / sure).alias("share"), sure.alias("sure"))


def host_reputation(hosts: DataFrame, prior: Reputation = Reputation(), scratch: Scratch | None = None) -> DataFrame:
    """(host, n_pages, n, bad) -> those and share, bound, blocked. A domain's and a suffix's rows are summed by task first; the level above is
    joined to the level below by groups of hosts, of which a suffix may hold most: suffixes of many hosts are broadcast.
    """
    scratch = scratch or Scratch(hosts.sparkSession, "reputation")
    hosts = scratch.save(hosts.select("host", "n_pages", "n", "bad", domain_of(F.col("host"), prior.suffixes).alias("domain"), suffix_of(F.col("host"), prior.suffixes).alias("suffix")), "hosts")
    sums = [F.sum(c).alias(c) for c in ("n", "bad")] + [F.sum("members").alias("members")]
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(*(F.sum(c).alias(c) for c in ("n", "bad")), F.count(F.lit(1)).alias("members")), "domains")
    suffixes = domains.withColumn("members", F.lit(1)).groupBy("suffix").agg(*sums)
    total = domains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("domains"), F.coalesce(F.sum("members"), F.lit(0)).alias("hosts")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1.0)
    suffixes = scratch.save(_level(suffixes.withColumn("mean", F.lit(mean)).withColumn("behind", F.lit(total["n"] + 1.0)), prior), "suffix-shares")
    above = suffixes.select("suffix", F.col("share").alias("mean"), F.col("sure").alias("behind"), F.col("members").alias("of"))
    domains = look_up(domains, above, ["suffix"], F.col("of") * 10_000 > total["domains"]).drop("of")
    domains = scratch.save(_level(domains, prior), "domain-shares")
    above = domains.select("domain", "suffix", F.col("share").alias("mean"), F.col("sure").alias("behind"), F.col("members").alias("of"))
    hosts = look_up(hosts, above, ["domain", "suffix"], F.col("of") * 10_000 > total["hosts"]).drop("of")
    shares = _level(hosts, prior)
    bound = F.col("share") - prior.z * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("sure") + 1))
    return scratch.save(shares.select("host", "n_pages", "n", "bad", "share", bound.alias("bound"), (bound > prior.limit).alias("blocked")), "host-shares")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, key: Column, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", prior: Reputation = Reputation()
) -> DataFrame:
    """Every row's id, host, path, rule, verdict, and the host's labelled pages, bad ones among them, share and bound.

    ``outcomes``: (key, bad); ``key``: an expression over ``pages`` that gives a page's outcome key, null where it has none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = pages[url_col].cast("string")
    counts = pages.select(host_of(url).alias("host"), key.alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    known = outcomes.where(F.col("key").isNotNull() & F.col("bad").isNotNull()).groupBy("key").agg(F.max("bad").alias("is_bad"))
    labelled = counts.join(known, "key", "left")
    counted = F.when(F.col("is_bad").isNotNull(), F.col("n_pages")).otherwise(0)
    bad = F.when(F.col("is_bad"), F.col("n_pages")).otherwise(0)
    hosts = scratch.save(labelled.groupBy("host").agg(F.sum("n_pages").alias("n_pages"), F.sum(counted).alias("n"), F.sum(bad).alias("bad")), "counts")
    judged = host_reputation(hosts, prior, scratch)
    n_pages = hosts.agg(F.sum("n_pages")).first()[0] or 0
    rows = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = look_up(rows, judged, ["host"], F.col("n_pages") * 10_000 > n_pages)
    found = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("found", found)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "share", "bound")
