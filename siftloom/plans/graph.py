"""Domain, pattern, robots and frontier queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.operators import frontier as FR
from siftloom.operators import patterns as PT
from siftloom.plans.registry import query
from siftloom.plans.tables import read

HOST = "regexp_extract(url, '://([^/?#:]+)', 1)"


@query("D7_host_suffix_join", f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), r AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\\.', '') AS dom FROM h WHERE page_id % 17 = 0),
x AS (SELECT DISTINCT 'deep.' || host AS dom FROM h WHERE page_id % 23 = 0), a AS (SELECT * FROM r UNION SELECT * FROM x)
SELECT page_id FROM h WHERE EXISTS (SELECT 1 FROM a WHERE host = dom OR host LIKE '%.' || dom OR dom LIKE '%.' || host)""")
def d7(spark, d):
    pages = read(spark, d, "pages")
    host = F.regexp_extract("url", "://([^/?#:]+)", 1)
    up = pages.where("page_id % 17 = 0").select(F.regexp_replace(host, r"^[^.]+\.", "").alias("domain"))
    deep = pages.where("page_id % 23 = 0").select(F.concat(F.lit("deep."), host).alias("domain"))
    return FR.filter_allowed_hosts(pages, up.union(deep)).select("page_id")


@query("D8_pattern_join", """SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM region WHERE regexp_matches(url, '/(en|fr)/[0-9]*' || r_regionkey || '([/?#.]|$)') AND r_regionkey < 4)""")
def d8(spark, d):
    patterns = read(spark, d, "region").where("r_regionkey < 4").select(
        F.concat(F.lit("/(en|fr)/[0-9]*"), "r_regionkey", F.lit("([/?#.]|$)")).alias("pattern")
    )
    return FR.matching_patterns(read(spark, d, "pages"), patterns).select("page_id")


_LISTS = """inc AS (SELECT CASE c_custkey % 5 WHEN 0 THEN '/(en|fr)/[0-9]*' || c_custkey || '([/?#.]|$)' WHEN 1 THEN '/de/' || (c_custkey % 97) || '\\d?$|/es/' || (c_custkey % 53)
    WHEN 2 THEN 'example\\.(com|org)/.*' || (c_custkey % 31) || '[05]' WHEN 3 THEN '^http://no-such-host-' || c_custkey ELSE '[13579]{2}' || (c_custkey % 7) || '$' END AS p FROM customer WHERE c_custkey % 2 = 0),
exc AS (SELECT '/' || (c_custkey % 40) || '([?].*)?$' AS p FROM customer WHERE c_custkey % 2 = 1 AND c_custkey < 30)"""


@query("D8_patterns_matched", f"""WITH {_LISTS}, i AS (SELECT page_id, min(p) AS included_by FROM pages JOIN (SELECT DISTINCT p FROM inc) ON regexp_matches(url, p) GROUP BY page_id),
e AS (SELECT page_id, min(p) AS excluded_by FROM pages JOIN (SELECT DISTINCT p FROM exc) ON regexp_matches(url, p) GROUP BY page_id)
SELECT page_id, included_by, excluded_by, included_by IS NOT NULL AND excluded_by IS NULL AS passes FROM pages LEFT JOIN i USING (page_id) LEFT JOIN e USING (page_id)""")
def d8_lists(spark, d):
    key = "cast(c_custkey as string)"
    c = read(spark, d, "customer")
    include = c.where("c_custkey % 2 = 0").select(F.expr(rf"""CASE c_custkey % 5 WHEN 0 THEN concat('/(en|fr)/[0-9]*', {key}, '([/?#.]|$)')
        WHEN 1 THEN concat('/de/', c_custkey % 97, r'\d?$|/es/', c_custkey % 53) WHEN 2 THEN concat(r'example\.(com|org)/.*', c_custkey % 31, '[05]')
        WHEN 3 THEN concat('^http://no-such-host-', {key}) ELSE concat('[13579]{{2}}', c_custkey % 7, '$') END""").alias("pattern"))
    exclude = c.where("c_custkey % 2 = 1 AND c_custkey < 30").select(F.expr("concat('/', c_custkey % 40, '([?].*)?$')").alias("pattern"))
    return PT.filter_by_patterns(read(spark, d, "pages"), include, exclude).select("page_id", "included_by", "excluded_by", "passes")


# robots files: one per host, written by a rule on the smallest page id of the host
BODY = """CASE k % 4 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'Sitemap: https://' || host || '/map.xml'
  WHEN 1 THEN '# c' || chr(10) || 'User-agent: badbot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /en/4' || chr(10) || 'Disallow: /en/' || chr(10) || 'Disallow: /fr'
  WHEN 2 THEN 'User-agent: Mozilla' || chr(10) || 'Disallow:' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' ELSE 'User-agent: *' || chr(10) || 'Disallow: /' END"""
_ROBOTS = f"h AS (SELECT page_id, url, {HOST} AS host FROM pages), k AS (SELECT host, min(page_id) AS k FROM h GROUP BY host)"


def _robots(spark, d):
    pages = read(spark, d, "pages")
    hosts = pages.groupBy(F.regexp_extract("url", "://([^/?#:]+)", 1).alias("host")).agg(F.min("page_id").alias("k"))
    return hosts.select("host", F.expr("CASE WHEN k % 4 = 3 THEN 404 ELSE 200 END").alias("status"), F.expr(BODY).alias("body"))


@query("D10_robots_allowed", f"""WITH {_ROBOTS}, p AS (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path, k FROM h JOIN k ON h.host = k.host)
SELECT page_id, CASE k % 4 WHEN 0 THEN NOT starts_with(path, '/en/') WHEN 1 THEN starts_with(path, '/en/4') OR NOT (starts_with(path, '/en/') OR starts_with(path, '/fr')) ELSE true END AS robots_allowed FROM p""")
def d10(spark, d):
    return FR.robots_allowed(read(spark, d, "pages"), _robots(spark, d)).select("page_id", "robots_allowed")


@query("D11_sitemaps", f"WITH {_ROBOTS} SELECT host, 'https://' || host || CASE WHEN k % 4 = 0 THEN '/map.xml' ELSE '/sitemap.xml' END AS sitemap FROM k")
def d11(spark, d):
    robots = _robots(spark, d)
    return FR.sitemaps_for(robots.select("host"), robots)


@query("A16_effective_domains", """SELECT DISTINCT 'col-' || s_suppkey AS collector_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['example.com', 'd' || s_suppkey || '.org'] ELSE ['s' || s_suppkey || '.example.com', 'b.example.net'] END) AS domain FROM supplier""")
def a16(spark, d):
    s = read(spark, d, "supplier").select(
        F.concat(F.lit("col-"), "s_suppkey").alias("collector_id"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN array(' Example.com', 'd' || s_suppkey || '.org', ' ') ELSE cast(array() as array<string>) END").alias("allowed_domains"),
        F.expr("array('https://S' || s_suppkey || '.example.com/a', 'http://b.example.net:80/', 'https://s' || s_suppkey || '.example.com/b')").alias("start_urls"),
    )
    return FR.effective_domains(s)


# --- frontier: pages linked as a tree with back links, files and outside links


def _graph_links(spark, d):
    """Page p links to pages 2p+1, 2p+2 and p/2, to one file, and to one outside page."""
    pages = read(spark, d, "pages")
    clean = F.regexp_extract("url", r"^([^?#]*)", 1)
    nodes = pages.select("page_id", F.concat(F.regexp_replace(clean, "/+$", ""), F.lit("/n"), "page_id").alias("url"))
    source = nodes.select(F.col("page_id").alias("p"), F.col("url").alias("page_url"))
    steps = source.select("page_url", F.explode(F.array(F.col("p") * 2 + 1, F.col("p") * 2 + 2, F.floor(F.col("p") / 2))).alias("page_id"))
    inner = steps.join(nodes, "page_id").select("page_url", "url")
    files = source.select("page_url", F.concat(F.lit("/files/"), F.col("p") % 40, F.lit(".pdf")).alias("url"))
    outside = source.select("page_url", F.concat(F.lit("https://elsewhere.example.edu/"), "p").alias("url"))
    return nodes, inner.union(files).union(outside)


_NODES = "n AS (SELECT page_id AS p, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') || '/n' || page_id AS url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages)"
_OK = "(regexp_matches(u, '^https?://([a-z0-9-]+\\.)*example\\.(com|net)/') AND NOT regexp_matches(u, 'n13$'))"
_WALK = f"""{_NODES}, e AS (SELECT a.url AS src, b.url AS u FROM n a JOIN n b ON b.p = 2 * a.p + 1 OR b.p = 2 * a.p + 2 OR b.p = a.p // 2),
w AS (SELECT url AS u, 0 AS depth FROM n WHERE p IN (0, 1) UNION SELECT e.u, w.depth + 1 FROM w JOIN (SELECT * FROM e WHERE {_OK}) e ON e.src = w.u WHERE w.depth < 6),
m AS (SELECT u AS url, min(depth) AS depth FROM w GROUP BY u)"""


def _walk(spark, d):
    nodes, links = _graph_links(spark, d)
    return FR.expand_frontier(
        links, nodes.where("page_id IN (0, 1)"), domains=["example.com", "example.net"], exclude=["n13$"],
        max_depth=6, max_pages=None, max_files=None,
    )


@query("D9_frontier_pages", f"WITH RECURSIVE {_WALK} SELECT url, depth FROM m")
def d9(spark, d):
    return _walk(spark, d)[0]


@query("D9_frontier_files", f"""WITH RECURSIVE {_WALK} SELECT origin || '/files/' || (p % 40) || '.pdf' AS url, min(depth) AS depth FROM m JOIN n ON m.url = n.url WHERE depth < 6 AND regexp_matches(origin, 'example\\.(com|net)$') GROUP BY 1""")
def d9b(spark, d):
    return _walk(spark, d)[1].select("url", "depth")


@query("L5_frontier_budget", f"WITH RECURSIVE {_WALK} SELECT url, depth FROM m ORDER BY depth, url LIMIT 12")
def l5(spark, d):
    nodes, links = _graph_links(spark, d)
    return FR.expand_frontier(
        links, nodes.where("page_id IN (0, 1)"), domains=["example.com", "example.net"], exclude=["n13$"],
        max_depth=6, max_pages=12, max_files=5,
    )[0]
