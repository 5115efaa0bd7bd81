"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Outcomes of labelled pages, bad or not, are counted per host, registered domain and suffix. A beta-binomial prior carries each level's rate down
to the next: the suffix is shrunk to the overall rate, the domain to its suffix, the host to its domain, each with a strength estimated from
how much the groups of that level differ. A host is blocked when the lower posterior bound of its bad rate exceeds a limit. Explicit
rules on host and path come before reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Common suffixes of two labels, where no list is given, and bounds on the strength of a prior.
LONG_SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "com.tr"]
WEAKEST, STRONGEST = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with suffix, the longest listed ending of a host or its last label, and domain, one label more. suffixes: suffix, any number of labels; by default LONG_SUFFIXES."""
    listed = suffixes if suffixes is not None else hosts.sparkSession.createDataFrame([(s,) for s in LONG_SUFFIXES], "suffix string")
    named = listed.select(F.lower("suffix").alias("ending")).filter("ending <> ''").distinct().withColumn("labels", F.size(F.split("ending", r"\.")))
    labels = F.size(F.split("host", r"\."))
    endings = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda n: F.array_join(F.slice(F.split("host", r"\."), labels - n + 1, n), "."))).alias("ending"))
    longest = endings.join(named, "ending").groupBy("host").agg(F.max("labels").alias("n"))
    last = lambda n: F.array_join(F.slice(F.split("host", r"\."), F.greatest(labels - n + 1, F.lit(1)), n), ".")
    n = F.coalesce("n", F.lit(1))
    return hosts.join(longest, "host", "left").withColumn("suffix", last(n)).withColumn("domain", last(n + 1)).drop("n")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: (verdict, host, path) holds for the host and its subdomains where the path starts so."""
    rule = verdict = F.lit(None).cast("string")
    for decision, on, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule, verdict = F.when(fits, on + start).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, group: str) -> DataFrame:
    """One row: rate and prior strength of a level by the method of moments, from its groups' labelled and bad counts."""
    seen = level.groupBy(group).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k")).filter("n > 0")
    sums = seen.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    rate = (F.col("k") + 1) / (F.col("n") + 2)
    spread = (F.col("kk") - F.col("k") * F.col("k") / F.col("n") - (F.col("g") - 1) * rate * (1 - rate)) / (F.col("n") - F.col("nn") / F.col("n"))
    strength = F.when((F.col("g") > 1) & (spread > 0), F.least(F.greatest(rate * (1 - rate) / spread - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)
    return sums.select(F.lit(group).alias("level"), F.coalesce(rate, F.lit(0.5)).alias("rate"), strength.alias("strength"))


def rule_outcomes(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Outcomes (page_id, bad) of the pages that an explicit rule judges: what the rules say about a host's pages is evidence on its other pages."""
    host, path = host_and_path(F.col("url").cast("string"))
    verdict = rule_for(host, path, rules)[1]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), (verdict == "block").cast("int").alias("bad")).dropna()


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Per host: labelled, bad, mean and deviation of the posterior of its bad rate.

    pages (page_id, host), outcomes (page_id, bad 0/1). Outcomes are summed per host before anything is joined by host. Hosts without labelled pages take their domain's rate; without any outcome all rates are 0.5.
    """
    counted = pages.join(outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(with_domain(cut(hosts), suffixes))
    levels = {r.level: r for r in _strength(hosts, "suffix").unionByName(_strength(hosts, "domain")).unionByName(_strength(hosts, "host")).collect()}  # three rows
    sums = [F.sum("labelled").alias("n"), F.sum("bad").alias("k")]
    shrunk = lambda prior, m: (F.col("k") + m * prior) / (F.col("n") + m)
    suffixes = hosts.groupBy("suffix").agg(*sums).select("suffix", shrunk(F.lit(levels["suffix"].rate), levels["suffix"].strength).alias("suffix_rate"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), levels["domain"].strength).alias("domain_rate"))
    m = levels["host"].strength
    a = F.col("bad") + m * F.col("domain_rate")
    b = F.col("labelled") - F.col("bad") + m * (1 - F.col("domain_rate"))
    return hosts.join(domains, "domain").select("host", "labelled", "bad", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], suffixes: DataFrame | None = None, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict on every page: (page_id, host, path, rule, verdict, labelled, bad, lower_bound).

    A page without a fitting rule is blocked if its host's bad rate exceeds `limit` at the lower posterior bound: mean less z deviations, the normal approximation to the quantile of the beta
    posterior. suffixes: a table of public suffixes. A null or relative url has an empty host, which is judged like any other; urls of any length are read whole; null page ids are kept and have no
    outcome; repeated rows give repeated verdicts; an empty table gives no rows. Hosts are broadcast to the pages if Spark finds their table small; else adaptive execution splits a frequent host.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")).dropna()
    hosts = cut(reputation(rows, known, suffixes))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    bound = F.round(F.greatest(F.col("mean") - z * F.col("deviation"), F.lit(0.0)), 9)
    out = rows.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), "labelled", "bad", bound.alias("lower_bound"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("lower_bound") > limit, "block").otherwise("allow")).alias("verdict"), "labelled", "bad", "lower_bound")
