"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and rolled up to the registered domain and the public suffix.
Each level has a beta-binomial prior whose strength is integrated over a few values, weighed by the groups of
that level and by the group's own outcomes; the suffix shrinks to the overall rate, the domain to its suffix,
the host to its domain. A host is blocked when the lower posterior bound of its bad rate is over a limit and
clear of the overall rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfix.session import join_sized, materialize

#: Public suffixes of two labels; any other host has its last label as suffix.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "net.au", "org.au", "org.uk")

#: Prior strengths in pseudo-outcomes, and the weight they share whatever the level's groups say.
STRENGTHS, DOUBT = (2.0, 8.0, 32.0, 128.0, 512.0, 2048.0), 0.1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; it fits the host and its subdomains where the url's path starts with the path."""

    text: str
    verdict: str

    def parts(self) -> tuple[str, str]:
        host, slash, path = self.text.partition("/")
        return host, slash + path


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_suffix(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*two_label) & (last_two != host), last_two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(last_two)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as ``struct<n, rule, verdict>``, or null; a rule both ways blocks.

    Only as many of a host's last labels are looked at as the deepest rule has.
    """
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.parts()[0], []).append(r)
    entry = lambda r: F.struct(F.lit(r.parts()[1]).alias("path"), F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
    table = F.map_from_arrays(F.array(*[F.lit(h) for h in by_host]), F.array(*[F.array(*[entry(r) for r in rs]) for rs in by_host.values()]))
    labels = F.least(F.lit(max(h.count(".") + 1 for h in by_host)), F.size(F.split(host, r"\.")))
    names = F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    found = F.flatten(F.filter(F.transform(names, lambda n: F.try_element_at(table, n)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number, by Stirling's series eight further on."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (y * y)) / (y * y)) / (y * y)) / y
    for pair in range(0, 8, 2):
        series = series - F.log((x + F.lit(float(pair))) * (x + F.lit(pair + 1.0)))
    return series


def _evidence(strength: float, prior: Column) -> Column:
    """Log-probability of ``bad`` of ``n`` outcomes under a beta prior of mean ``prior`` and ``strength`` pseudo-outcomes."""
    a, b, m, n, bad = F.lit(strength) * prior, F.lit(strength) * (1 - prior), F.lit(strength), F.col("n"), F.col("bad")
    return _lgamma(a + bad) - _lgamma(a) + _lgamma(b + n - bad) - _lgamma(b) - _lgamma(m + n) + _lgamma(m)


def _posterior(groups: DataFrame, prior: str) -> DataFrame:
    """``groups`` (n, bad, ``prior``) with ``rate`` and ``variance`` of each one's posterior, integrated over ``STRENGTHS``.

    A strength's weight is its likelihood over the groups of the level, mixed with ``DOUBT`` spread evenly; a
    group's own outcomes then weigh the strengths again. So one that the level's common strength can't
    explain is led by its own outcomes, however alike the others are.
    """
    inside = F.least(F.greatest(F.col(prior), F.lit(1e-9)), F.lit(1 - 1e-9))
    scored = materialize(groups.withColumns({"inside": inside, "evidence": F.array(*[_evidence(m, inside) for m in STRENGTHS])}))
    total = scored.where(F.col("n") > 0).agg(*[F.coalesce(F.sum(F.col("evidence")[k]), F.lit(0.0)) for k in range(len(STRENGTHS))]).first()
    likelihood = [math.exp(v - max(total)) for v in total]
    log_weight = [math.log((1 - DOUBT) * v / sum(likelihood) + DOUBT / len(STRENGTHS)) for v in likelihood]
    own = [F.col("evidence")[k] + F.lit(w) for k, w in enumerate(log_weight)]
    shares = [F.exp(v - F.greatest(*own)) for v in own]
    means = [(F.lit(m) * F.col("inside") + F.col("bad")) / (F.lit(m) + F.col("n")) for m in STRENGTHS]
    squares = [p * p + p * (1 - p) / (F.lit(m) + F.col("n") + 1) for m, p in zip(STRENGTHS, means, strict=True)]
    mix = lambda values: sum((w * v for w, v in zip(shares, values, strict=True)), F.lit(0.0)) / sum(shares, F.lit(0.0))
    moments = scored.withColumns({"rate": mix(means), "square": mix(squares)})
    return moments.withColumn("variance", F.greatest(F.col("square") - F.col("rate") * F.col("rate"), F.lit(0.0))).drop("inside", "evidence", "square")


def host_reputation(pages: DataFrame, outcomes: DataFrame, page_key: str, outcome_key: str, z: float = 1.645) -> DataFrame:
    """``(host, n, bad, bad_lower, overall)`` of every host of ``pages`` (columns ``page_key`` and ``host``).

    ``outcomes`` has ``outcome_key`` and a boolean ``is_bad``; null keys and null outcomes don't count.
    ``bad_lower`` is posterior mean less ``z`` posterior standard deviations. A host without outcomes gets
    its domain's estimate with the width of the prior. ``overall`` is the rate of all outcomes.
    """
    tally = (
        outcomes.where(F.col(outcome_key).isNotNull() & F.col("is_bad").isNotNull())
        .groupBy(F.col(outcome_key).alias(page_key))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bad").cast("long")).alias("bad"))
    )
    zero = F.lit(0).cast("long")
    hosts = materialize(
        pages.join(tally, page_key, "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum("bad"), zero).alias("bad"))
        .withColumns({"domain": registered_domain(F.col("host")), "suffix": host_suffix(F.col("host"))})
    )
    sums = lambda df, *keys: materialize(df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix")
    base = F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0))
    mean = suffixes.agg(base).first()[0]
    suffixes = _posterior(suffixes.withColumn("mean", F.lit(mean)), "mean").select("suffix", F.col("rate").alias("suffix_rate"))
    domains = _posterior(join_sized(domains, materialize(suffixes), ["suffix"]), "suffix_rate").select("domain", F.col("rate").alias("domain_rate"))
    judged = _posterior(join_sized(hosts, materialize(domains), ["domain"]), "domain_rate")
    return judged.select("host", "n", "bad", (F.col("rate") - F.lit(z) * F.sqrt("variance")).alias("bad_lower"), F.lit(mean).alias("overall"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], page_key: str = "page_id", outcome_key: str = "doc_id", max_bad: float = 0.25, z: float = 1.645, margin: float = 0.1) -> DataFrame:
    """One row per row of ``pages`` (``page_key``, ``url``): key, host, path, rule, verdict, bad_lower.

    A fitting rule decides (longest wins); any other page is blocked when its host's ``bad_lower`` is over
    ``max_bad`` and over the overall rate plus ``margin`` of what that leaves to 1, so that in a table of many
    bad outcomes a host is not blocked for being like the others. Urls that are null, empty or without ``://`` have empty host and path and share the
    reputation of the empty host. Repeated rows each return; an empty table returns no row; other columns
    of the inputs are ignored.
    """
    parsed = pages.select(page_key, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    reputation = materialize(host_reputation(parsed, outcomes, page_key, outcome_key, z).select("host", "bad_lower", "overall"))
    hit = F.col("hit")
    judged = join_sized(parsed, reputation, ["host"], "left").withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    limit = F.greatest(F.lit(max_bad), F.col("overall") + F.lit(margin) * (1 - F.col("overall")))
    own = F.when(F.col("bad_lower") > limit, "block").otherwise("allow")
    return judged.select(page_key, "host", "path", hit["rule"].alias("rule"), F.coalesce(hit["verdict"], own).alias("verdict"), "bad_lower")
