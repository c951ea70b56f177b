"""URL filter: fixed host/path rules first, then Empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk from the top down with
beta-binomial priors: suffix -> registered domain -> host.  The prior of a level has the
mean of the level above and a strength fitted by moments over that level's members, but
never more than the pages that the mean itself rests on.  A host is blocked when the lower credible bound of its bad rate exceeds ``BLOCK_ABOVE``.
A host of which no page is labelled is judged by that prior alone: mean and strength of its
domain, else of its suffix, else of all pages.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule and is allowed; repeated rows get one verdict each; labels that are null or name no
page do not count; without any label every page without a rule is allowed; an empty
table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.llm.registry import query, table

#: (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A host is blocked if its bad rate is above this with 95 % posterior probability.
BLOCK_ABOVE = 0.5
Z = 1.645
#: Bounds of a fitted prior strength (in pages) and the rate used without any label.
STRENGTH = (2.0, 1000.0)
DEFAULT_RATE = 0.05

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null.

    The rules are literals of the plan, so the list is meant to be short (thousands).
    """
    found = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*found)) if found else F.lit(None)


def _levels(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return domain, F.element_at(labels, -1)


def _shrunk(rows: DataFrame, above: str, name: str) -> DataFrame:
    """Add rate and weight (in pages) of each member, from its n and bad and those of the level above."""
    m = F.col(f"rate_{above}")
    between = F.pow(F.col("bad") / F.nullif(F.col("n"), F.lit(0)) - m, 2)
    fit = rows.where("n > 0").agg(
        F.sum(F.col("n") * between).alias("spread"), F.sum(m * (1 - m)).alias("noise"),
        F.sum(m * (1 - m) * F.col("n")).alias("full"))
    # E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (s + 1))
    over = (F.col("spread") - F.col("noise")) / (F.col("full") - F.col("noise"))
    strength = F.when(over > 0, F.least(F.greatest(1 / over - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
    fit = fit.select(F.coalesce(strength, F.lit(STRENGTH[1])).alias(f"s_{name}"))  # one row
    rows = rows.join(F.broadcast(fit)).withColumn(f"s_{name}", F.least(f"s_{name}", f"weight_{above}"))
    return rows.withColumns({
        f"rate_{name}": (F.col("bad") + F.col(f"s_{name}") * m) / (F.col("n") + F.col(f"s_{name}")),
        f"weight_{name}": F.col("n") + F.col(f"s_{name}")})


def reputation(outcomes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Posterior of each host from ``outcomes`` (host, bad boolean): rate, lower bound, n, bad.

    The hosts of ``seen`` (host) that have no outcome get a posterior too, with n = 0.
    """
    counted = outcomes.where("bad is not null").select("host", F.lit(1).alias("n"), F.col("bad").cast("long").alias("bad"))
    if seen is not None:
        counted = counted.unionByName(seen.select("host", F.lit(0).alias("n"), F.lit(0).cast("long").alias("bad")))
    hosts = counted.where("host <> ''").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = _levels(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    pages = F.nullif(F.sum("n"), F.lit(0))  # null without any label
    top = suffixes.agg(F.coalesce(F.sum("bad") / pages, F.lit(DEFAULT_RATE)).alias("rate_all"), pages.alias("weight_all"))
    suffixes = _shrunk(suffixes.join(F.broadcast(top)), "all", "suffix").select("suffix", "rate_suffix", "weight_suffix")
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix", "domain").select("domain", "rate_domain", "weight_domain")
    posterior = _shrunk(hosts.join(domains, "domain"), "domain", "host")
    rate, weight = F.col("rate_host"), F.col("weight_host")
    bound = rate - Z * F.sqrt(rate * (1 - rate) / (weight + 1))
    return posterior.select("host", "n", "bad", rate.alias("rate"), bound.alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``outcomes`` has (host, bad)."""
    rows = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rows = rows.withColumn("_rule", longest_rule(F.col("host"), F.col("path")))
    bad = reputation(outcomes, rows.select("host")).where(F.col("bound") > BLOCK_ABOVE).select(F.col("host").alias("_host"))
    rows = rows.join(bad, F.col("host") == F.col("_host"), "left")
    learned = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return rows.withColumns({
        "rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), learned),
    }).drop("_rule", "_host")


#: The test pages name the document they show by the number that ends their path.
_NUMBER = r"/([0-9]{1,18})(?:\.html|/)?$"

_SQL = f"""WITH p AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
g AS (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(\\.html|/)?$', 1), '') AS BIGINT) AS number FROM h WHERE host <> ''),
o AS (SELECT host, count(doc_id) AS n, coalesce(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN doc_id IS NOT NULL THEN 0 END), 0) AS bad
  FROM g LEFT JOIN (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) ON doc_id = number GROUP BY host),
hs AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM o),
ds AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY ALL),
ss AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM ds GROUP BY ALL),
s1 AS (SELECT *, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), {DEFAULT_RATE}) FROM ss) AS m, (SELECT nullif(sum(n), 0) FROM ss) AS w FROM ss),
f1 AS (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * n) - sum(m * (1 - m)), 0) AS v FROM s1 WHERE n > 0),
k1 AS (SELECT coalesce(CASE WHEN v > 0 THEN least(greatest(1 / v - 1, {STRENGTH[0]}), {STRENGTH[1]}) END, {STRENGTH[1]}) AS s FROM f1),
r1 AS (SELECT suffix, (bad + least(s, w) * m) / (n + least(s, w)) AS m, n + least(s, w) AS w FROM s1, k1),
s2 AS (SELECT ds.*, m, w FROM ds JOIN r1 USING (suffix)),
f2 AS (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * n) - sum(m * (1 - m)), 0) AS v FROM s2 WHERE n > 0),
k2 AS (SELECT coalesce(CASE WHEN v > 0 THEN least(greatest(1 / v - 1, {STRENGTH[0]}), {STRENGTH[1]}) END, {STRENGTH[1]}) AS s FROM f2),
r2 AS (SELECT domain, (bad + least(s, w) * m) / (n + least(s, w)) AS m, n + least(s, w) AS w FROM s2, k2),
s3 AS (SELECT hs.*, m, w FROM hs JOIN r2 USING (domain)),
f3 AS (SELECT (sum(n * (bad / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * n) - sum(m * (1 - m)), 0) AS v FROM s3 WHERE n > 0),
k3 AS (SELECT coalesce(CASE WHEN v > 0 THEN least(greatest(1 / v - 1, {STRENGTH[0]}), {STRENGTH[1]}) END, {STRENGTH[1]}) AS s FROM f3),
r3 AS (SELECT host, (bad + least(s, w) * m) / (n + least(s, w)) AS rate, n + least(s, w) AS w FROM s3, k3),
b AS (SELECT host AS bad_host FROM r3 WHERE rate - {Z} * sqrt(rate * (1 - rate) / (w + 1)) > {BLOCK_ABOVE}),
rules(v, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
won AS (SELECT DISTINCT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM (SELECT DISTINCT host, path FROM h)
  JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, h.host, h.path, rule, coalesce(v, CASE WHEN bad_host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN won ON won.host = h.host AND won.path = h.path LEFT JOIN b ON bad_host = h.host"""


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of each page whose document has both labels."""
    number = F.regexp_extract(path_of(F.col("url")), _NUMBER, 1)
    seen = (
        pages.select(host_of(F.col("url")).alias("host"), number.alias("_n"))
        .select("host", F.expr("try_cast(nullif(_n, '') as bigint)").alias("_doc")))
    marks = labels.select(F.col("doc_id").alias("_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"),
                          (F.col("quality").isNotNull() & F.col("toxic").isNotNull()).alias("_both"))
    return seen.join(marks.where("_both"), F.col("_doc") == F.col("_id")).select("host", "bad")


@query("op7_url_reputation", _SQL)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = labelled_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_verdicts(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")
