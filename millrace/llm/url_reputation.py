"""URL filter: explicit rules first, then empirical-Bayes reputation of the host. DataFrame functions only.

Reputation: page outcomes (good or bad) are counted by host and shrunk level by level: a host's rate towards that of its
registered domain, a domain's towards its suffix, a suffix's towards the rate of all. Each level's prior strength is
estimated by moments of the beta-binomial from all labelled hosts. A host passes if the lower bound of its posterior
rate of good pages reaches ``least_good``; hosts without outcomes are judged by their domain's, suffix's or the whole rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, read, written

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels; any other suffix is a host's last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")
DEFAULT_STRENGTH = 10.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def registered_domain(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is left out."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    last_two = F.substring_index(bare, ".", -2)
    suffix = F.when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(last_two.isin(*two_label), F.substring_index(bare, ".", -3)).otherwise(last_two)
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host and path; nulls if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def _pooled(child: DataFrame, parent: str) -> DataFrame:
    """Counts of the parents, and the moments of their labelled children's rates around them."""
    return child.groupBy(parent).agg(
        F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count(F.when(F.col("n") > 0, 1)).alias("g"),
        F.sum(F.when(F.col("n") > 0, F.col("k") * F.col("k") / F.col("n")).otherwise(0.0)).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )


def _strength(pooled: DataFrame) -> float:
    """Prior strength: 1 / rho - 1, rho being the children's correlation by moments."""
    p = F.col("pk") / F.col("pn")
    spread, pq = F.col("kk") - F.col("pk") * p, p * (1 - p)
    row = pooled.where("pn > 0").agg(F.sum(spread).alias("s"), F.sum(pq * (F.col("g") - 1)).alias("e"), F.sum(pq * (F.col("pn") - F.col("nn") / F.col("pn"))).alias("c")).first()
    if row.s is None or row.c - row.e <= 1e-12:
        return DEFAULT_STRENGTH
    rho = min(max((row.s - row.e) / (row.c - row.e), 1e-4), 0.9999)
    return 1 / rho - 1


def host_reputation(urls: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host of ``urls`` (page_id, host): n, k, posterior rate and its lower bound.

    ``outcomes`` (page_id, good) may have several rows per page or none; each is a trial. Null ids and null outcomes are
    no trials. Without any trial, the rate of all is one half.
    """
    trials = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    domain, suffix = registered_domain(F.col("host"))
    hosts = written(
        urls.join(trials, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("k"))
        .withColumns({"domain": domain, "suffix": suffix}), "hosts",
    )
    by_domain = _pooled(hosts, "domain")
    domains = hosts.select("domain", "suffix").distinct().join(by_domain, "domain").select("domain", "suffix", F.col("pn").alias("n"), F.col("pk").alias("k"))
    by_suffix = _pooled(domains, "suffix")
    suffixes = by_suffix.select("suffix", F.col("pn").alias("n"), F.col("pk").alias("k")).withColumn("top", F.lit(1))
    by_all = _pooled(suffixes, "top")
    s_host, s_domain, s_suffix = _strength(by_domain), _strength(by_suffix), _strength(by_all)
    everything = by_all.first()
    rate = ((everything.pk if everything else 0) + 1) / ((everything.pn if everything else 0) + 2)
    suffix_rate = by_suffix.select("suffix", ((F.col("pk") + s_suffix * rate) / (F.col("pn") + s_suffix)).alias("rs"))
    domain_rate = by_domain.join(hosts.select("domain", "suffix").distinct(), "domain").join(suffix_rate, "suffix").select("domain", ((F.col("pk") + s_domain * F.col("rs")) / (F.col("pn") + s_domain)).alias("rd"))
    mean, size = (F.col("k") + s_host * F.col("rd")) / (F.col("n") + s_host), F.col("n") + s_host
    return hosts.join(domain_rate, "domain").select("host", "n", "k", mean.alias("rate"), (mean - z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, least_good: float = 0.5, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A verdict per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, rate, bound.

    A page's outcome is good where its label (doc_id = page_id) has quality 1 and isn't toxic; a null quality is no label,
    a null toxic counts as not toxic. Repeated rows give repeated verdicts, null urls are judged as the empty host, and
    other columns of either table are ignored. Only one hot host's rows may fill a join partition; Spark's adaptive skew
    join splits those, and the reputation side has one row per host.
    """
    host, path = split_url(F.col("__url"))
    urls = pages.select("page_id", F.col("url").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).cast("int")
    reputation = host_reputation(urls.select("page_id", "host"), labels.select(F.col("doc_id").alias("page_id"), good.alias("good")))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") >= least_good, "allow").otherwise("block")
    return urls.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_method).alias("verdict"), F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound")
    )


def op1_url_reputation(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH u0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
t AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS k FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM u LEFT JOIN t USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(bare, '.') AS parts FROM h0),
h2 AS (SELECT *, array_to_string(parts[-2:], '.') AS two FROM h1),
h AS (SELECT host, n, k, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'com.br', 'co.in', 'co.za') THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
 CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'com.br', 'co.in', 'co.za') THEN two ELSE parts[-1] END AS suffix FROM h2),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k, count(*) FILTER (n > 0) AS g, sum(CASE WHEN n > 0 THEN k * k / n ELSE 0 END) AS kk, sum(n * n) AS nn FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, count(*) FILTER (n > 0) AS g, sum(CASE WHEN n > 0 THEN k * k / n ELSE 0 END) AS kk, sum(n * n) AS nn FROM d GROUP BY suffix),
a AS (SELECT sum(n) AS n, sum(k) AS k, count(*) FILTER (n > 0) AS g, sum(CASE WHEN n > 0 THEN k * k / n ELSE 0 END) AS kk, sum(n * n) AS nn FROM s),
m AS (SELECT lvl, sum(kk - k * k / n) AS sp, sum(k / n * (1 - k / n) * (g - 1)) AS e, sum(k / n * (1 - k / n) * (n - nn / n)) AS c
 FROM (SELECT 'h' AS lvl, n, k, g, kk, nn FROM d UNION ALL SELECT 'd', n, k, g, kk, nn FROM s UNION ALL SELECT 's', n, k, g, kk, nn FROM a) WHERE n > 0 GROUP BY lvl),
w AS (SELECT lvl, CASE WHEN c - e <= 1e-12 THEN 10.0 ELSE 1 / least(greatest((sp - e) / (c - e), 1e-4), 0.9999) - 1 END AS st FROM m),
c AS (SELECT (SELECT coalesce(max(st), 10.0) FROM w WHERE lvl = 'h') AS sh, (SELECT coalesce(max(st), 10.0) FROM w WHERE lvl = 'd') AS sd, (SELECT coalesce(max(st), 10.0) FROM w WHERE lvl = 's') AS ss, (SELECT (coalesce(k, 0) + 1) / (coalesce(n, 0) + 2) FROM a) AS r),
rs AS (SELECT suffix, (k + ss * r) / (n + ss) AS rs FROM s, c),
rd AS (SELECT domain, (k + sd * rs) / (n + sd) AS rd FROM d JOIN rs USING (suffix), c),
p0 AS (SELECT host, (k + sh * rd) / (n + sh) AS rate, n + sh AS size FROM h JOIN rd USING (domain), c),
p AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) AS bound FROM p0),
v AS (SELECT u.page_id, u.host, u.path, rate, bound,
 CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u JOIN p USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
 round(rate, 6) AS rate, round(bound, 6) AS bound FROM v
"""
