"""URL filters: ordered host and path rules, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. Beta-binomial priors shrink them level by level: the suffix towards all
pages, the registered domain towards its suffix, the host towards its domain. The mean of a prior comes from the level
above without the unit's own counts, its strength from how much the units of a level differ (method of moments on the
counts, pooled over their parents). A page without a matching rule is blocked where the posterior of its host's share of
bad pages lies above the threshold with enough probability, that is, where its lower quantile does.

Pages are reduced to their distinct hosts; rules and reputation meet these, and one join takes the results back.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the
share of its (empty) host like any other. Repeated page rows are each judged. Labels with null ids or
outcomes are ignored, repeated labels of a page count once (bad if any is bad). Without labels every
unmatched page is allowed. Extra columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import ascii_lower, materialize

#: Rule tables, and tables of distinct hosts, up to so many rows are broadcast; larger ones are joined by shuffling both
#: sides, where Spark splits a host with very many pages.
BROADCAST_RULES, BROADCAST_HOSTS = 10_000, 50_000
#: Bounds of an estimated strength (in pages), and the one where nothing can be estimated.
LEAST_STRENGTH, MOST_STRENGTH, STRENGTH = 1.0, 1000.0, 20.0
#: Steps of the posterior's integral on either side of the threshold, each an eighth of its standard deviation (in log-odds).
STEPS = 160
#: A label before a country's two letters that makes a public suffix with it, as in co.uk.
SECOND_LEVEL = "ac co com edu gob gov go ltd me mil ne net nom or org plc sch".split()
_SECOND = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path."""
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("__u"))
    host, path = host_path(F.col("__u"))
    return base.select("page_id", host.alias("host"), path.alias("path"))


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it; a shorter host is its own domain."""
    return F.when(host.rlike(_SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column) -> Column:
    """The last label, or the last two where these are a country's second level."""
    return F.when(host.rlike(_SECOND), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, __rules: the rules (rule, p, v) of each of the distinct hosts that has some.

    rules: host, path, verdict. They are gathered by host, so a host meets at most one row for each of its labels.
    """
    n = rules.limit(BROADCAST_RULES + 1).count()
    by_host = rules.where("host is not null and path is not null").groupBy(F.col("host").alias("__rh")).agg(F.collect_set(F.struct(F.col("path").alias("p"), F.col("verdict").alias("v"))).alias("__rs"))
    labels = F.split(F.col("host"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = hosts.withColumn("__rh", F.explode(tails)).join(F.broadcast(by_host) if n <= BROADCAST_RULES else by_host, "__rh")
    return hits.groupBy("host").agg(F.flatten(F.collect_list(F.expr("transform(__rs, r -> struct(concat(__rh, r.p) as rule, r.p as p, r.v as v))"))).alias("__rules"))


#: The longest rule whose path the page's path starts with (ties: the first in text order), or null.
_BEST = "get(array_sort(filter(__rules, r -> startswith(path, r.p)), (a, b) -> case when length(a.rule) <> length(b.rule) then length(b.rule) - length(a.rule) when a.rule < b.rule then -1 when a.rule > b.rule then 1 else 0 end), 0)"


def strength(units: DataFrame, parent: list[str], name: str) -> DataFrame:
    """One row: the strength of a beta prior around the parent's share, from units with n outcomes, bad of them bad.

    With shares p = bad / n, the variation of the units within a parent beyond that of chance gives the correlation rho
    of outcomes within a unit, pooled over the parents; the strength is (1 - rho) / rho.
    """
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    g = units.where("n > 0").groupBy(*parent).agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("b"), F.sum(n * n).alias("q"), F.sum(bad * bad / n).alias("a"))
    within = F.expr("b / n * (1 - b / n)")
    extra = F.expr("a - b * b / n") - within * F.expr("k - 1")
    full = within * F.expr("n - q / n - (k - 1)")
    rho = g.agg(F.sum(extra).alias("e"), F.sum(full).alias("f"))
    value = F.when(F.col("e") > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), (F.col("f") - F.col("e")) / F.col("e")))).otherwise(MOST_STRENGTH)
    return rho.select(F.when(F.col("f") > 0, value).otherwise(STRENGTH).alias(name))


def tail(a: Column, b: Column, share: float) -> Column:
    """The probability of a Beta(a, b) value above `share`, for a and b of 1/2 at least: Simpson's rule on the log-odds scale, on either side."""
    import math

    at = math.log(share / (1 - share))
    mode, step = F.log(a / b), F.sqrt(1 / a + 1 / b) / 8
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    top = a * mode - (a + b) * soft(mode)
    weight = lambda j: F.when((j == 0) | (j == STEPS), 1.0).when(j % 2 == 1, 4.0).otherwise(2.0)

    def side(sign: int) -> Column:
        x = lambda j: F.lit(at) + sign * j * step
        return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, j: s + weight(j) * F.exp(a * x(j) - (a + b) * soft(x(j)) - top))

    above, below = side(1), side(-1)
    return F.when(above + below > 0, above / (above + below)).otherwise(F.when(mode > at, 1.0).otherwise(0.0))


def host_reputation(counts: DataFrame, threshold: float) -> DataFrame:
    """host, n, bad, bad_share (posterior mean), risk (probability that the share of bad pages is above the threshold; null without any label).

    counts: host, n, bad for every distinct host (zero without labels). Every level is a grouped sum of the one below.
    """
    counts = counts.withColumn("dom", registered_domain(F.col("host"))).withColumn("suf", suffix(F.col("host")))
    dom = counts.groupBy("dom", "suf").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suf = dom.groupBy("suf").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suf.agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"))
    for units, parent, name in ((suf, [], "k1"), (dom, ["suf"], "k2"), (counts, ["dom", "suf"], "k3")):
        top = top.crossJoin(strength(units, parent, name))  # one row each
    suf = suf.withColumnsRenamed({"n": "sn", "bad": "sb"}).crossJoin(F.broadcast(top)).withColumn("sm", F.expr("(tb - sb + 1) / (tn - sn + 2)"))
    dom = dom.withColumnsRenamed({"n": "dn", "bad": "db"}).join(suf, "suf").withColumn("dm", F.expr("(sb - db + k1 * sm) / (sn - dn + k1)"))
    a, b = F.expr("bad + k3 * hm + 0.5D"), F.expr("n - bad + k3 * (1 - hm) + 0.5D")
    found = counts.join(dom, ["dom", "suf"]).withColumn("hm", F.expr("(db - bad + k2 * dm) / (dn - n + k2)")).withColumns({"a": a, "b": b})
    return found.select("host", "n", "bad", F.expr("a / (a + b)").alias("bad_share"), F.when(F.col("tn") > 0, tail(F.col("a"), F.col("b"), threshold)).alias("risk"))


def filter_urls(pages: DataFrame, rules: DataFrame, outcomes: DataFrame, threshold: float = 0.2, confidence: float = 0.975) -> DataFrame:
    """page_id, host, path, rule, verdict, by_rule, host_labelled: one row per page row.

    outcomes: page_id, bad (0/1).
    """
    parsed = parse(pages)
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = parsed.where("page_id is not null").join(labelled, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = parsed.select("host").distinct().join(counts, "host", "left").select("host", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"))
    hosts = materialize(hosts, "hosts")
    judged = host_reputation(hosts, threshold).select("host", "n", (F.coalesce("risk", F.lit(0.0)) >= confidence).alias("__bad"))
    judged = materialize(judged.join(rules_of_hosts(hosts.select("host"), rules), "host", "left"), "judged")
    small = judged.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    best = F.expr(_BEST)
    joined = parsed.join(F.broadcast(judged) if small else judged, "host", "left").withColumn("__best", best)
    method = F.when(F.col("__bad"), "block").otherwise("allow")
    rule = F.col("__best.rule")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(F.col("__best.v"), method).alias("verdict"), rule.isNotNull().alias("by_rule"), F.col("n").alias("host_labelled"))
