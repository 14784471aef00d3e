"""URL filters: fixed rules first, then empirical-Bayes reputation of hosts, in DataFrame functions only.

Pages with an outcome are counted by host, registered domain and suffix.  Rates of bad pages are beta-distributed about
the level above: suffixes about the overall rate, domains about their suffix, hosts about their domain.  How strongly is
estimated from the data, for each level from how much its members' rates differ beyond chance (the beta-binomial's
intra-class correlation, by moments), so where hosts are alike few own pages count little, and where they differ much;
and a prior is never stronger than what is known of its mean, so a domain with one page says little about its hosts.
A host is blocked if a low quantile of its posterior, a beta distribution, is over a threshold, that is, if the
distribution's value at the threshold is under ``alpha``; so hosts with few pages are never blocked for bad luck.  A
host without outcomes has its domain's rate, or without any there its suffix's, or else the overall rate, under the same bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import settle

#: Fixed: the rules of the registered query, as (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Fixed: some suffixes of two labels that sites are registered under; public lists have thousands, which ``suffixes`` takes.
SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.mx", "gov.uk", "org.uk"]
#: A level's strength, in pages, is kept between these; equal rates have the larger one.
WEAKEST, STRONGEST = 1.0, 1_000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Lower-cased between the first :// and the next /, ?, # or the end; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first in the end
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without a user before it and a port after it."""
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def _is_address(site: Column) -> Column:
    return site.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")


def suffix_of(site: Column, suffixes: list[str] | None = None) -> Column:
    """The last label, or the last two if they are one of ``suffixes``; an address is its own suffix."""
    labels = F.split(site, "\\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when(_is_address(site), site).when((F.size(labels) > 1) & two.isin(SUFFIXES if suffixes is None else suffixes), two).otherwise(F.element_at(labels, -1))


def domain_of(site: Column, suffixes: list[str] | None = None) -> Column:
    """The label before the suffix, and the suffix; an address is its own domain."""
    labels = F.split(site, "\\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    n = F.when(two.isin(SUFFIXES if suffixes is None else suffixes), 3).otherwise(2)
    return F.when(~_is_address(site) & (F.size(labels) > n), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")).otherwise(site)


def outcome(quality: Column, toxic: Column) -> Column:
    """1 for a page whose document is labelled bad or toxic, 0 for one that is labelled good and isn't, else null; the url has no say."""
    return F.when((quality == 0) | (toxic == 1), 1).when(quality == 1, 0)


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 10, and back by the product between."""

    def series(z: Column) -> Column:
        y = z + 10
        between = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(1.0), lambda acc, k: acc * (z + k))
        return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - F.log(between)

    return _once(z, series)


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def beta_below(a: Column, b: Column, x: float) -> Column:
    """The beta distribution's value at ``x``: its continued fraction, on the side where that converges fast."""

    def fraction(v: Column) -> Column:
        p, q, y = v["p"], v["q"], v["y"]
        safe = lambda t: F.when(F.abs(t) < 1e-30, F.lit(1e-30)).otherwise(t)

        def term(acc: Column, n: Column) -> Column:
            m = F.floor(n / 2)
            even = m * (q - m) * y / ((p + n - 1) * (p + n))
            odd = -(p + m) * (p + q + m) * y / ((p + n - 1) * (p + n))
            return _once(F.when(n % 2 == 0, even).otherwise(odd), lambda t: _once(F.struct((1 / safe(1 + t * acc["d"])).alias("d"), safe(1 + t / acc["c"]).alias("c")), lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (acc["h"] * s["c"] * s["d"]).alias("h"))))

        start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"))
        steps = (F.lit(60) + 6 * F.ceil(F.sqrt(p + q))).cast("int")
        # the first term is 1, so its inverse begins the product
        h = F.aggregate(F.sequence(F.lit(1), steps), start, term, lambda acc: acc["h"])
        front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(y) + q * F.log(1 - y)) / p
        return F.when(v["turned"], 1 - front / h).otherwise(front / h)

    def sides(v: Column) -> Column:
        a, b = v["a"], v["b"]
        turned = F.lit(x) > (a + 1) / (a + b + 2)
        return F.struct(F.when(turned, b).otherwise(a).alias("p"), F.when(turned, a).otherwise(b).alias("q"), F.when(turned, 1 - x).otherwise(x).alias("y"), turned.alias("turned"))

    return _once(_once(F.struct(a.alias("a"), b.alias("b")), sides), fraction)


def _spread(rows: DataFrame, group: list[str], n: str, bad: str, name: str) -> DataFrame:
    """One row with the strength (pages) with which members of ``rows`` are held to their group's rate.

    By moments: the squares of the members' rates about their group's, against what chance alone would give.
    """
    c = F.col
    some = rows.where(c(n) > 0)
    per = some.groupBy(*group) if group else some.groupBy()
    per = per.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("N"), F.sum(bad).alias("B"), F.sum(c(n) * c(n)).alias("N2"), F.sum(c(bad) * c(bad) / c(n)).alias("S"))
    p = c("B") / c("N")
    chance = p * (1 - p)
    sums = per.agg(F.sum(c("S") - c("B") * p - chance * (c("k") - 1)).alias("x"), F.sum(chance * (c("N") - c("N2") / c("N") - (c("k") - 1))).alias("y"))
    strength = F.when((c("x") > 0) & (c("y") > 0), (c("y") - c("x")) / c("x")).otherwise(F.lit(STRONGEST))
    return sums.select(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), strength)).alias(name))


def reputation(outcomes: DataFrame, threshold: float = 0.3, others: DataFrame | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """Per host of ``outcomes`` (host, bad) and of ``others`` (host), without users and ports: host, n, bad, a and b (its posterior), rate (mean), below (its value at ``threshold``).

    Counts are summed before any shuffle, so a host that a third of all pages have costs a row per task; the levels above
    are sums of these.  Null outcomes and empty hosts are ignored.  Hosts of ``others`` add no counts.  Without any
    outcome the overall rate is a half.
    """
    seen = outcomes.where("bad IS NOT NULL").select("host", F.lit(1).cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("bad"))
    if others is not None:
        zero = F.lit(0).cast("bigint")
        seen = seen.unionByName(others.select("host", zero.alias("n"), zero.alias("bad")))
    hosts = seen.withColumn("host", site_of(F.col("host"))).where("host <> ''").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = settle(hosts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes)))
    domains = settle(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    base = suffixes.agg(((F.coalesce(F.sum("sb"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("base"))
    levels = base
    for level in (_spread(suffixes, [], "sn", "sb", "ms"), _spread(domains, ["suffix"], "dn", "db", "md"), _spread(hosts, ["domain", "suffix"], "n", "bad", "mh")):
        levels = levels.join(level)  # one row each
    base, ms, md, mh, pages = levels.join(suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("pages"))).first()

    def shrunk(bad: str, n: str, prior: Column, above: Column) -> list[Column]:
        return [((F.col(bad) + prior * above) / (F.col(n) + prior)).alias("rate"), (F.col(n) + prior).alias("pages")]

    def prior(m: float, above: Column) -> Column:
        """The strength of a prior whose mean is known no better than from ``above`` pages: variances about the mean add up."""
        return F.greatest(F.lit(0.5), 1 / (1 / (F.lit(m) + 1) + 1 / (above + 1)) - 1)

    suffixes = suffixes.select("suffix", *shrunk("sb", "sn", prior(ms, F.lit(pages + 2.0)), F.lit(base)))
    domains = domains.join(suffixes, "suffix").withColumn("prior", prior(md, F.col("pages"))).select("domain", "suffix", *shrunk("db", "dn", F.col("prior"), F.col("rate")))
    out = hosts.join(domains, ["domain", "suffix"]).withColumn("prior", prior(mh, F.col("pages")))
    out = out.select("host", "n", "bad", (F.col("bad") + F.col("prior") * F.col("rate")).alias("a"), (F.col("n") - F.col("bad") + F.col("prior") * (1 - F.col("rate"))).alias("b"))
    return out.select("*", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), beta_below(F.col("a"), F.col("b"), threshold).alias("below"))


def judge(pages: DataFrame, outcomes: DataFrame, keep: dict[str, Column], url: str = "url", rules: list[tuple[str, str]] | None = None, threshold: float = 0.3, alpha: float = 0.01, suffixes: list[str] | None = None) -> DataFrame:
    """Per page: ``keep``, host, path, rule, verdict (allow or block).

    A rule's verdict holds; without one, block if the ``alpha`` quantile of the host's rate of bad pages is over
    ``threshold``, also for hosts that ``outcomes`` doesn't have.  Null urls and urls without :// have empty host and
    path, and are allowed; urls of any length are read whole.  An empty table of pages gives no rows, and one of outcomes blocks
    nobody.  Extra columns are ignored.  Only hosts that are blocked join with pages.
    """
    u = F.col(url)
    df = pages.select(*[c.alias(n) for n, c in keep.items()], host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    df = df.withColumn("rule", rule).withColumn("_verdict", verdict)
    df = df.withColumn("_site", site_of(F.col("host")))
    blocked = reputation(outcomes, threshold, df.select("host"), suffixes).where(F.col("below") < alpha).select(F.col("host").alias("_site"), F.lit("block").alias("_host"))
    return df.join(blocked, "_site", "left").select(*keep, "host", "path", "rule", F.coalesce("_verdict", "_host", F.lit("allow")).alias("verdict"))
