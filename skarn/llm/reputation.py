"""URL filters by rules and by an empirical-Bayes reputation of hosts.

Outcomes of labelled pages (bad or not) are counted by host, registered domain and suffix. A
beta-binomial model shrinks them from the top down: the prior of a suffix has the mean of all pages,
that of a domain the posterior mean of its suffix, that of a host the posterior mean of its domain.
How strong the prior of a level is comes from the data (moments: how much more the shares of its
groups differ from their parents' means than draws of pages would). A host is blocked where the
lower bound of its posterior share of bad pages is over a limit, so a few bad pages alone block none.

Only DataFrame functions are used; what is shuffled are ids, hosts and paths, never the pages' html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Second labels that make a suffix of two labels with a country's label of two letters (fixed values).
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: One-sided 95 % bound, the share of bad pages over which a host is blocked, and the range of a prior's strength in pages.
Z, LIMIT, WEAK, STRONG = 1.6449, 0.5, 2.0, 1000.0


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url: what stands after the first :// up to / ? #, with A-Z in lower case; then up to ? #. Without :// both are empty."""
    rest = F.expr(f"if(locate('://', {url}) > 0, substring({url}, locate('://', {url}) + 3), '')")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null. Of rules of one length, blocking ones come first, then the alphabet decides."""
    fitting = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fitting.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def parents(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: its last two labels and the last one, or three and two under suffixes like co.uk. Numeric and one-label hosts are domains of their own under no suffix."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "\\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    wide = (n > 2) & (F.length(last) == 2) & second.isin(SECOND)
    take = lambda k: F.when(n >= k, F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), "."))
    alone = (n < 2) | last.rlike("^[0-9]*$")
    return F.when(alone, host).otherwise(F.when(wide, take(3)).otherwise(take(2))), F.when(alone, F.lit("")).otherwise(F.when(wide, take(2)).otherwise(last))


def strength(groups: DataFrame) -> float:
    """How many pages the prior of a level counts for. groups: n, bad and the parent's mean m of each group with labelled pages."""
    v = F.col("m") * (1 - F.col("m"))
    spread = F.col("n") * (F.col("bad") / F.col("n") - F.col("m")) ** 2
    rho = F.try_divide(F.sum(spread) - F.sum(v), F.sum(v * (F.col("n") - 1)))
    kappa = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONG))
    found = groups.where("n > 0").agg(F.greatest(F.lit(WEAK), F.least(F.lit(STRONG), kappa)).alias("k")).first()
    return float(found.k) if found.k is not None else STRONG


def _mean(k: float, prior: str) -> Column:
    return (F.lit(k) * F.col(prior) + F.col("bad")) / (F.lit(k) + F.col("n"))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, domain, suffix, n (labelled pages), bad, mean and bound (posterior share of bad pages and its lower bound) of each host. hosts: host, n, bad, one row for each host."""
    domain, suffix = parents(F.col("host"))
    hosts = common.stage(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = common.stage(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), *sums), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = domains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    suffixes = suffixes.withColumn("m", F.lit((total.bad + 1) / (total.n + 2)))
    suffixes = suffixes.select("suffix", _mean(strength(suffixes), "m").alias("m"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", _mean(strength(domains), "m").alias("m"))
    own = hosts.join(domains, "domain")
    k = strength(own)
    mean = _mean(k, "m")
    out = own.select("host", "domain", "suffix", "n", "bad", mean.alias("mean"), (F.lit(k) + F.col("n")).alias("weight"))
    return out.select("host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), mean and bound of every row of pages (page_id, url).

    outcomes: page_id, bad (boolean). An id that stands there several times is bad if one row says so;
    null ids and outcomes say nothing. Rows of pages that repeat an id count each, with its outcome.
    Null urls and those without :// have the empty host and share its reputation. A port belongs to
    the host. rules are part of the plan: a list of some hundreds at most. The rule's verdict goes
    before the reputation's. Without outcomes all priors are even, and nothing is blocked by reputation.
    """
    host, path = split_url()
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    said = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null")
    said = said.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = own.select("page_id", "host").join(said, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = reputations(hosts, z).select("host", "mean", "bound")
    ruled = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return ruled.join(known, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "mean", "bound")


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only outcomes among the tables are those of `labels`; a page is bad if its id's quality label is 0."""
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(common.table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op12_urls": op12_urls}

ORACLE_SQL = {
    "op12_urls": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, rh, rp)),
l AS (SELECT doc_id AS page_id, max((quality = 0)::int) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::double AS bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS p FROM h LEFT JOIN l USING (page_id) GROUP BY host),
k AS (SELECT *, len(p) < 2 OR regexp_matches(p[-1], '^[0-9]*$') AS alone, len(p) > 2 AND length(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS wide FROM c),
o AS (SELECT host, n, bad, CASE WHEN alone THEN host WHEN wide THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
  CASE WHEN alone THEN '' WHEN wide THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM k),
d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM o GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM d) AS m FROM d GROUP BY suffix),
ks AS (SELECT coalesce(greatest(2, least(1000, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 1000 END)), 1000) AS k FROM (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS r FROM s WHERE n > 0)),
ms AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s, ks),
dd AS (SELECT domain, n, bad, m FROM d JOIN ms USING (suffix)),
kd AS (SELECT coalesce(greatest(2, least(1000, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 1000 END)), 1000) AS k FROM (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS r FROM dd WHERE n > 0)),
md AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM dd, kd),
oo AS (SELECT host, o.n, o.bad, m FROM o JOIN md USING (domain)),
kh AS (SELECT coalesce(greatest(2, least(1000, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 1000 END)), 1000) AS k FROM (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0) AS r FROM oo WHERE n > 0)),
g AS (SELECT host, (k * m + bad) / (k + n) AS mean, k + n AS w FROM oo, kh),
b AS (SELECT host, mean - 1.6449 * sqrt(mean * (1 - mean) / (w + 1)) AS bound FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, v DESC, rh || rp) AS i FROM (SELECT DISTINCT host, path FROM h) JOIN f ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, h.host, h.path, rh || rp AS rule, coalesce(v, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN b ON b.host = h.host LEFT JOIN q ON q.host = h.host AND q.path = h.path AND q.i = 1""",
}
