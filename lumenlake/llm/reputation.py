"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. A beta-binomial prior
passes down: the suffix shrinks towards the overall rate, the domain towards its suffix, the host towards its domain; no
group's own outcomes count in the prior it gets. Each level's prior strength comes from the over-dispersion of its own
groups (method of moments; four rows of sums reach the driver). A host is blocked if the lower bound of its posterior,
the quantile of 1 - certainty, lies above the threshold, that is, if the posterior gives rates above the threshold the
certainty or more; this tail of the beta distribution is integrated in DataFrame functions. Fixed rules go first. Counts
are pre-aggregated by host and written before anything is shuffled by domain or suffix, and the last join carries one
row a host, so that a host with a third of the pages is only a skewed join side, which AQE splits.

Cases: a null url, or one without ``://``, has an empty host and path and is judged as the host ''; labels of no page
and null outcomes are not counted; of several labels of one page any bad one counts; repeated pages are each judged;
an address of numbers is a domain and suffix of its own; urls of any length are matched whole; other columns are not
read; an empty table, or one without labels, gives verdicts from the rules and the neutral prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Labels under which registries of two-letter country domains sell names, such as com.pl or ac.uk.
SECOND_LEVELS = (
    "ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gub", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch",
)


@dataclass(frozen=True)
class Suffixes:
    """Rules of a public suffix list: names, parents of wildcards ("ck" for "*.ck"), and exceptions to these."""

    names: frozenset[str]
    wildcards: frozenset[str]
    exceptions: frozenset[str]

    @staticmethod
    def parse(lines: Iterable[str]) -> Suffixes:
        rules = [x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")]
        return Suffixes(frozenset(r for r in rules if r[0] not in "*!"), frozenset(r[2:] for r in rules if r.startswith("*.")), frozenset(r[1:] for r in rules if r[0] == "!"))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Prior:
    """Overall rate and the strengths, in pseudo-pages, of the priors of suffixes, domains and hosts."""

    rate: float
    suffix: float
    domain: float
    host: float


#: Strengths lie between these; with no labels the rate is neutral.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
NEUTRAL_RATE = 0.1


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, "^.*@|:[0-9]*$", "")


def _labels_of_suffix(bare: Column, suffixes: Suffixes | None) -> Column:
    """How many labels of a name its public suffix has; 0 for an address of numbers, which is its own."""
    last, two = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    if suffixes is None:
        n = F.when(two.rlike(rf"^({'|'.join(SECOND_LEVELS)})\.[a-z][a-z]$"), 2).otherwise(1)
    else:
        n = F.lit(1)
        most = max((r.count(".") + 2 for r in suffixes.names | suffixes.wildcards), default=1)
        for k in range(2, most + 1):
            name, parent = F.substring_index(bare, ".", -k), F.substring_index(bare, ".", -(k - 1))
            has = (F.size(F.split(bare, r"\.")) >= k) & (name.isin(*suffixes.names) | parent.isin(*suffixes.wildcards) & ~name.isin(*suffixes.exceptions))
            n = F.when(has, k).otherwise(n)
    return F.when(last.rlike("^[0-9]+$") | bare.startswith("["), 0).otherwise(n)


def _last_labels(bare: Column, n: Column) -> Column:
    parts = F.split(bare, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.size(parts)), ".")


def suffix_of(host: Column, suffixes: Suffixes | None = None) -> Column:
    """The public suffix of a host without user and port; without a list, by the labels that registries use."""
    bare = _bare(host)
    n = _labels_of_suffix(bare, suffixes)
    return F.when(n == 0, bare).otherwise(_last_labels(bare, n))


def domain_of(host: Column, suffixes: Suffixes | None = None) -> Column:
    """The registered domain: the public suffix and one label more."""
    bare = _bare(host)
    n = _labels_of_suffix(bare, suffixes)
    return F.when(n == 0, bare).otherwise(_last_labels(bare, n + 1))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits host and path, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first, so it wraps the others
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _strength(x: Row | None) -> float:
    """Pseudo-pages of the prior from which groups' rates seem drawn, by their sums: intraclass correlation by moments."""
    if not x or not x["N"] or x["g"] < 2:
        return MOST_STRENGTH
    p = x["K"] / x["N"]
    within = p * (1 - p)
    spread = within * (x["N"] - x["n2"] / x["N"] - (x["g"] - 1))
    rho = (x["kk"] - x["N"] * p * p - within * (x["g"] - 1)) / spread if spread > 0 else 0.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - rho) / rho)) if rho > 0 else MOST_STRENGTH


def host_counts(pages: DataFrame, outcomes: DataFrame, suffixes: Suffixes | None = None) -> DataFrame:
    """Labelled pages n and bad ones k of every host of pages(page_id, host); outcomes: (page_id, bad)."""
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    return (
        pages.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0)).cast("long")).alias("k"))
        .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    )


def fit_prior(hosts: DataFrame) -> Prior:
    """Rate and strengths, from the sums of all levels' groups in one pass over hosts(host, domain, suffix, n, k)."""
    level = F.explode(F.array(*(F.struct(F.lit(name).alias("level"), F.col(name).alias("group")) for name in ("suffix", "domain", "host")))).alias("x")
    groups = hosts.select(level, "n", "k").groupBy("x.level", "x.group").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.col("n"), F.col("k")
    sums = groups.where(n > 0).groupBy("level").agg(F.sum(n).alias("N"), F.sum(k).alias("K"), F.count("*").alias("g"), F.sum(n * n).alias("n2"), F.sum(k * k / n).alias("kk"))
    by = {x["level"]: x for x in sums.collect()}  # three rows
    rate = (by["host"]["K"] + 1) / (by["host"]["N"] + 2) if by else NEUTRAL_RATE
    return Prior(rate, *(_strength(by.get(name)) for name in ("suffix", "domain", "host")))


def beta_tail(a: Column, b: Column, threshold: float, certainty: float) -> Column:
    """P(x > threshold) of x drawn from Beta(a, b), where it can decide whether that reaches certainty; else 0 or 1.

    With x = 1 / (1 + exp(-u)) the density is smooth over all u; it is summed at even steps from the threshold on, to
    both sides. Means that are too low, or too high, for the certainty (Markov's inequality) are not summed.
    """
    at, mean = math.log(threshold / (1 - threshold)), a / (a + b)
    mode, wide = F.log(a / b), F.sqrt(1 / a + 1 / b)
    step = F.least(wide, F.lit(1.0)) / 10
    up, down = (mode + 12 * wide + 20 / b - at) / step, (at - mode + 12 * wide + 20 / a) / step
    height = lambda u: -a * F.log(1 + F.exp(-u)) - b * F.log(1 + F.exp(u))

    def side(steps: Column, sign: int) -> Column:
        some = F.sequence(F.lit(1), F.greatest(F.ceil(steps), F.lit(1)).cast("int"))
        return F.aggregate(some, F.lit(0.0), lambda total, j: total + F.exp(height(at + sign * j * step) - height(mode)))

    middle = F.exp(height(F.lit(at)) - height(mode)) / 2
    over, under = side(up, 1) + middle, side(down, -1) + middle
    return (
        F.when(mean < certainty * threshold, 0.0).when((1 - mean) <= (1 - certainty) * (1 - threshold), 1.0).when(up <= 0, 0.0).when(down <= 0, 1.0).otherwise(over / (over + under))
    )


def posterior(hosts: DataFrame, prior: Prior, threshold: float, certainty: float) -> DataFrame:
    """(host, n_labelled, bad_rate, tail): posterior mean of each host's rate, and P(rate > threshold)."""
    n, k = F.col("n"), F.col("k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    for_domain = (F.col("sk") - F.col("dk") + prior.suffix * prior.rate) / (F.col("sn") - F.col("dn") + prior.suffix)
    domains = domains.join(suffixes, "suffix").select("domain", "dn", "dk", for_domain.alias("above"))
    for_host = (F.col("dk") - k + prior.domain * F.col("above")) / (F.col("dn") - n + prior.domain)
    found = hosts.join(domains, "domain").select("host", "n", "k", (prior.host * for_host).alias("a0"), (prior.host * (1 - for_host)).alias("b0"))
    found = found.select("host", "n", (k + F.col("a0")).alias("a"), (n - k + F.col("b0")).alias("b"))
    return found.select("host", F.col("n").alias("n_labelled"), (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), beta_tail(F.col("a"), F.col("b"), threshold, certainty).alias("tail"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), threshold: float = 0.35, certainty: float = 0.95, suffixes: Suffixes | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict, and the posterior it rests on."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts, _ = materialise(host_counts(urls.select("page_id", "host"), outcomes, suffixes), "hosts")
    rated, _ = materialise(posterior(hosts, fit_prior(hosts), threshold, certainty), "reputation")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("tail") >= certainty, "block").otherwise("allow")
    return urls.join(rated, "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "bad_rate", "tail")
