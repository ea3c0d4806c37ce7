"""URL filter: empirical-Bayes host reputation under explicit allow and block rules. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import hot_lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of several labels under which registries sell names, where a caller gives no list of its own (read_suffixes).
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


@dataclass(frozen=True)
class Rule:
    """action: allow or block; text: host, then a path that begins with a slash, e.g. example.com/en/."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        host, slash, rest = self.text.partition("/")
        return slash + rest


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; none: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; none: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Text of the longest rule that fits, else null. Of equally long ones the longer host wins, then the first."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def read_suffixes(path: str) -> tuple[str, ...]:
    """Suffixes of two labels and more from a file in the format of the public suffix list: one a line, // before remarks.
    Lines with a wildcard or an exception are left out."""
    with open(path, encoding="utf-8") as lines:
        found = (line.split() for line in lines)
        return tuple(w[0].lower() for w in found if w and "." in w[0] and w[0][0] not in "/*!")


def _labels(host: Column, suffixes: tuple[str, ...], more: int) -> Column:
    """The longest of suffixes that host ends with, else its last label, and so many labels more."""
    out = F.substring_index(host, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        fits = F.substring_index(host, ".", -n).isin([s for s in suffixes if s.count(".") + 1 == n])
        out = F.when(fits, F.substring_index(host, ".", -n - more)).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The part that a registry sells names under."""
    return _labels(host, suffixes, 0)


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more, or the host where there is none."""
    return _labels(host, suffixes, 1)


def concentration(groups: DataFrame) -> float:
    """Strength of the beta prior that a parent gives its groups (columns parent, n, good), by moments of the beta-binomial:
    the spread of groups around the rate of their own parent, beyond what binomial chance gives, over all parents.

    One row of sums comes to the driver. Without parents of two groups, or such spread, groups count as alike and the
    strength is the largest allowed, 1000; it is never under 1.
    """
    of = groups.where("n > 0").groupBy("parent").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum("good") / F.sum("n")).alias("p"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("y2"),
    )
    chance = F.col("p") * (1 - F.col("p"))
    s = of.agg(
        F.sum(F.col("y2") - F.col("n") * F.col("p") * F.col("p") - chance * (F.col("k") - 1)).alias("between"),
        F.sum(chance * (F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1))).alias("most"),
    ).first()
    if not s.most or s.most <= 1e-9:
        return 1000.0
    return 1 / min(max(s.between / s.most, 1 / 1001), 0.5) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, min_good: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row a host: host, n_pages, n, good, mean, upper and verdict.

    pages: host, page_id; outcomes: page_id, good (boolean; rows repeated for a page count as good if all are). The
    rate of good pages of a suffix is shrunk to that of all labelled pages, a domain's to its suffix's, a host's to its
    domain's, each through a beta prior whose strength the groups of that level give. A host is blocked if the upper
    posterior bound of its rate (mean + z standard deviations) is under min_good; unlabelled hosts inherit the prior.
    Null hosts count as the empty host. No labels: every host has mean 1/2 and is allowed.
    """
    labels = outcomes.groupBy("page_id").agg(F.min(F.col("good").cast("long")).alias("good"))
    hosts = (
        pages.select("page_id", F.coalesce("host", F.lit("")).alias("host")).join(labels, "page_id", "left")
        .groupBy("host").agg(F.count("*").alias("n_pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
        .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    )
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    registries = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    every = registries.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = every.good / every.n if every.n else 0.5
    ks, kd, kh = (concentration(x.withColumn("parent", p)) for x, p in ((registries, F.lit("")), (domains, F.col("suffix")), (hosts, F.col("domain"))))
    of_suffix = registries.select("suffix", ((F.col("good") + ks * base) / (F.col("n") + ks)).alias("mean_suffix"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", ((F.col("good") + kd * F.col("mean_suffix")) / (F.col("n") + kd)).alias("mean_domain"))
    a, b = F.col("good") + kh * F.col("mean_domain"), F.col("n") - F.col("good") + kh * (1 - F.col("mean_domain"))
    mean = a / (a + b)
    upper = mean + z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.join(of_domain, "domain").select(
        "host", "n_pages", "n", "good", mean.alias("mean"), upper.alias("upper"), F.when(upper < min_good, "block").otherwise("allow").alias("verdict")
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], z: float = 1.645, min_good: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Verdict on every row of pages (page_id, url; further columns are ignored).

    Returns page_id, host, path, rule (text of the longest fitting rule, else null), verdict (the rule's action, else
    the host's by host_reputation), good_rate and upper_bound of the host. Rows keep their number: repeated page_ids
    give a row each. Null urls and urls without :// have an empty host and path. No pages: no rows.
    """
    action = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.action)]) if rules else None
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = host_reputation(judged, outcomes, z, min_good, suffixes).select("host", "n_pages", F.col("mean").alias("good_rate"), F.col("upper").alias("upper_bound"), F.col("verdict").alias("by_host"))
    out = hot_lookup(judged, hosts, "host", "n_pages", pages.count())
    ruled = F.element_at(action, F.col("rule")) if rules else F.lit(None).cast("string")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), ruled).otherwise(F.col("by_host")).alias("verdict"), "good_rate", "upper_bound")
