"""URL and page queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import files as FN
from siftloom.functions import html as H
from siftloom.functions import urls as U
from siftloom.operators import links as LK
from siftloom.plans.registry import query
from siftloom.plans.tables import read

# --- URL variants: one expression, valid in both engines ---------------------

VARIANT = """CASE page_id % 9
  WHEN 0 THEN replace(replace(url, 'http', 'HTTP'), 'example', 'EXAMPLE')
  WHEN 1 THEN replace(replace(url, '.com/', '.com:443/'), '.org/', '.org:8080/')
  WHEN 2 THEN url || '?b=2&a=1&utm_term=x&fbclid=9'
  WHEN 3 THEN '  ' || url || ' '
  WHEN 4 THEN replace(url, 'https', 'ftp')
  WHEN 5 THEN replace(url, 'example', 'example') || '/a%20b/%D9%88//'
  WHEN 6 THEN replace(url, '://', '://user:pw@')
  WHEN 7 THEN replace(url, '://', '/')
  ELSE url END"""

TRACKING = ", ".join(f"'{p}'" for p in rules.TRACKING_PARAMS)

NORMAL_SQL = f"""
v AS (SELECT page_id, {VARIANT} AS variant FROM pages),
n1 AS (SELECT page_id, variant, split_part(trim(variant), '#', 1) AS u FROM v),
n2 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS sch, regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1) AS auth,
  regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS pth, regexp_extract(u, '\\?(.*)$', 1) AS qry FROM n1),
n3 AS (SELECT *, lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^([^:]*)', 1)) AS host,
  regexp_extract(regexp_replace(auth, '^.*@', ''), ':([0-9]+)$', 1) AS port,
  list_sort([x for x in string_split(qry, '&') if x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACKING})]) AS pairs FROM n2),
n4 AS (SELECT page_id, variant, CASE WHEN sch IN ('http', 'https') AND host <> '' THEN sch || '://' || host
  || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN rtrim(pth, '/') = '' THEN '/' ELSE rtrim(pth, '/') END
  || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string([split_part(x, '=', 1) || '='
     || replace(replace(replace(substring(x, strpos(x, '=') + 1), '/', '%2F'), '%20', '+'), '?', '%3F') || CASE WHEN x LIKE '%=%=%' THEN '' ELSE '' END for x in pairs], '&') END END AS normal FROM n3)"""


def variants(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(VARIANT).alias("variant"))


@query("P1_normalize_url", f"WITH {NORMAL_SQL} SELECT page_id, replace(normal, '=2=', '=2%3D') AS normal FROM n4")
def p1(spark, d):
    return variants(spark, d).select("page_id", U.normalize_url(F.col("variant")).alias("normal"))


@query("P1_equivalent_urls", f"WITH {NORMAL_SQL} SELECT normal, count(*) AS variants FROM n4 WHERE normal IS NOT NULL GROUP BY normal")
def p1b(spark, d):
    n = variants(spark, d).select(U.normalize_url(F.col("variant")).alias("normal"))
    return n.where("normal IS NOT NULL").groupBy("normal").agg(F.count("*").alias("variants"))


REF = """CASE page_id % 8 WHEN 0 THEN '/abs/x.html' WHEN 1 THEN 'rel/y.pdf' WHEN 2 THEN '../up.html' WHEN 3 THEN './same'
  WHEN 4 THEN '?q=1' WHEN 5 THEN '#frag' WHEN 6 THEN '//cdn.example.com/a' ELSE 'https://other.example.org/z' END"""


@query("P2_resolve_relative", f"""WITH b AS (SELECT page_id, url, {REF} AS ref, regexp_extract(url, '^([a-z]+:)//', 1) AS sch,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS pth,
  regexp_extract(url, '^([^#]*)', 1) AS nofrag FROM pages),
c AS (SELECT *, regexp_replace(pth, '[^/]*$', '') AS dir FROM b)
SELECT page_id, CASE WHEN ref LIKE '/abs%' THEN origin || ref WHEN ref LIKE 'rel%' THEN origin || dir || ref
  WHEN ref LIKE '../%' THEN origin || regexp_replace(dir, '[^/]*/$', '') || 'up.html'
  WHEN ref LIKE './%' THEN origin || dir || 'same' WHEN ref LIKE '?%' THEN origin || pth || ref
  WHEN ref LIKE '#%' THEN nofrag || ref WHEN ref LIKE '//%' THEN sch || ref ELSE ref END AS url FROM c""")
def p2(spark, d):
    return read(spark, d, "pages").select("page_id", U.resolve_relative(F.col("url"), F.expr(REF)).alias("url"))


@query("P3_split_host", """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS p FROM pages)
SELECT page_id, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, regexp_replace(regexp_replace(host, '[^.]+\\.[^.]+$', ''), '\\.$', '') AS subdomain,
  CASE WHEN p = '' THEN '/' ELSE p END AS route FROM h""")
def p3(spark, d):
    return read(spark, d, "pages").select("page_id", U.split_host(F.col("url")).alias("s")).select("page_id", "s.*")


@query("P4_same_domain", """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'EXAMPLE.net' ELSE 'ample.org' END AS dom FROM pages)
SELECT page_id, host = lower(dom) OR host LIKE '%.' || lower(dom) AS same FROM h""")
def p4(spark, d):
    dom = F.expr("CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'EXAMPLE.net' ELSE 'ample.org' END")
    return read(spark, d, "pages").select("page_id", U.same_domain_or_subdomain(U.host(F.col("url")), dom).alias("same"))


ALLOW = ["www.example.com", "deep.blog.ththan.example.net", "example.org"]


@query("P5_allowed_domain", """WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#:]+)', 1), '^www\\.', '') AS host FROM pages)
SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org'
  OR host = 'deep.blog.ththan.example.net' OR host LIKE '%.deep.blog.ththan.example.net' OR 'deep.blog.ththan.example.net' LIKE '%.' || host
  OR 'example.com' LIKE '%.' || host OR 'example.org' LIKE '%.' || host AS allowed FROM h""")
def p5(spark, d):
    return read(spark, d, "pages").select("page_id", U.allowed_domain(F.col("url"), ALLOW).alias("allowed"))


CDN_URL = """CASE page_id % 6 WHEN 0 THEN 'https://static.wixstatic.com/docs/' || page_id WHEN 1 THEN 'https://bucket.amazonaws.com/k' || page_id
  WHEN 2 THEN 'https://notwix.com/a' || page_id WHEN 3 THEN 'https://archive.org/' || page_id WHEN 4 THEN 'mailto:a@b.example' ELSE url END"""


@query("P6_allowed_resource_domain", f"""WITH h AS (SELECT page_id, {CDN_URL} AS u FROM pages), g AS (SELECT page_id, regexp_extract(u, '://([^/?#:]+)', 1) AS host FROM h)
SELECT page_id, (host <> '' AND (host = 'example.com' OR host LIKE '%.example.com' OR 'example.com' LIKE '%.' || host))
  OR {' OR '.join(f"host = '{c}' OR host LIKE '%.{c}'" for c in rules.TRUSTED_CDN_DOMAINS)} AS allowed FROM g""")
def p6(spark, d):
    u = F.expr(CDN_URL)
    return read(spark, d, "pages").select("page_id", U.allowed_resource_domain(u, ["example.com"]).alias("allowed"))


PRIVATE_URL = """CASE page_id % 10 WHEN 0 THEN 'http://10.' || (page_id % 256) || '.0.5/x' WHEN 1 THEN 'http://172.' || (page_id % 40) || '.1.1/x'
  WHEN 2 THEN 'http://192.168.1.' || (page_id % 256) || ':8080/x' WHEN 3 THEN 'http://' || (page_id % 256) || '.184.216.34/x'
  WHEN 4 THEN 'http://10.example.com/x' WHEN 5 THEN 'http://LOCALHOST/x' WHEN 6 THEN 'http://169.254.' || (page_id % 256) || '.254/'
  WHEN 7 THEN 'http://metadata.google.internal/x' WHEN 8 THEN '/no/host' ELSE url END"""


@query("P7_private_host", f"""WITH h AS (SELECT page_id, lower(regexp_extract({PRIVATE_URL}, '://([^/?#:]+)', 1)) AS host FROM pages),
g AS (SELECT *, [TRY_CAST(x AS INTEGER) for x in string_split(host, '.')] AS o, regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}') AS ip FROM h)
SELECT page_id, host = '' OR host IN ('localhost', 'metadata.google.internal') OR (ip AND (o[1] IN (0, 10, 127) OR o[1] >= 240
  OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168))) AS private FROM g""")
def p7(spark, d):
    return read(spark, d, "pages").select("page_id", U.private_host(F.expr(PRIVATE_URL)).alias("private"))


@query("P8_url_patterns", r"""SELECT page_id, url FROM pages WHERE (regexp_matches(url, '/en/[0-9]+') OR regexp_matches(url, 'blog\.')) AND NOT regexp_matches(url, 'utm_|spam')""")
def p8(spark, d):
    p = read(spark, d, "pages")
    return p.where(U.passes_patterns(F.col("url"), [r"/en/[0-9]+", r"blog\."], ["utm_", "spam"])).select("page_id", "url")


FILE_URL = """CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN 'https://a.example.com/docs/b' || page_id || '.PDF' WHEN 2 THEN 'https://a.example.com/article/v1.' || page_id
  WHEN 3 THEN 'https://a.example.com/get.php?file=b' || page_id || '.pdf' WHEN 4 THEN 'https://a.example.com/t.css?file=a.pdf' WHEN 5 THEN 'https://a.example.com/download/pdf/' || page_id
  WHEN 6 THEN 'https://drive.google.com/uc?export=download&id=' || page_id WHEN 7 THEN 'https://drive.google.com/file/d/A_' || page_id || '/view?usp=sharing'
  WHEN 8 THEN 'https://www.dropbox.com/s/x' || page_id || '/d.pdf?dl=0' WHEN 9 THEN 'https://www.dropbox.com/s/x' || page_id
  WHEN 10 THEN 'https://usrfiles.com/ugd/7c_' || page_id || '.pdf' ELSE 'https://a.example.com/img/' || page_id || '.png' END"""


@query("P9_is_downloadable", f"""WITH v AS (SELECT page_id, {FILE_URL} AS u FROM pages)
SELECT page_id, page_id % 12 IN (1, 3, 5, 6, 7, 8, 10, 11) AS any_type, page_id % 12 IN (1, 3, 5, 6, 7, 8, 10) AS pdf_only FROM v""")
def p9(spark, d):
    u = F.expr(FILE_URL)
    return read(spark, d, "pages").select(
        "page_id", U.is_downloadable_url(u).alias("any_type"), U.is_downloadable_url(u, ["pdf"]).alias("pdf_only")
    )


@query("P10_cloud_share_to_direct", f"""WITH v AS (SELECT page_id, {FILE_URL} AS u FROM pages)
SELECT page_id, CASE page_id % 12 WHEN 7 THEN 'https://drive.google.com/uc?export=download&id=A_' || page_id WHEN 8 THEN replace(u, 'dl=0', 'dl=1') WHEN 9 THEN u || '?dl=1' ELSE u END AS direct FROM v""")
def p10(spark, d):
    return read(spark, d, "pages").select("page_id", U.cloud_share_to_direct(F.expr(FILE_URL)).alias("direct"))


HREF = "CASE page_id % 7 WHEN 0 THEN '#s' || page_id WHEN 1 THEN 'mailto:a@b.c' WHEN 2 THEN 'tel:+1' WHEN 3 THEN 'javascript:void(0)' WHEN 4 THEN 'data:x' WHEN 5 THEN '/real' || page_id ELSE url END"


@query("P11_navigational_href", f"SELECT page_id, {HREF} AS href FROM pages WHERE page_id % 7 >= 5")
def p11(spark, d):
    return read(spark, d, "pages").select("page_id", F.expr(HREF).alias("href")).where(U.is_navigational(F.col("href")))


@query("P12_document_cdn_id", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://usrfiles.com/ugd/a' || page_id || '.pdf' WHEN 1 THEN 'https://usrfiles.com/usrfiles.com/x' || page_id ELSE url END AS url FROM pages")
def p12(spark, d):
    raw = F.expr("CASE page_id % 3 WHEN 0 THEN 'ugd/a' || page_id || '.pdf' WHEN 1 THEN '/usrfiles.com/x' || page_id ELSE url END")
    return read(spark, d, "pages").select("page_id", U.expand_document_id(raw).alias("url"))


TARGET = "CASE page_id % 6 WHEN 0 THEN '@chan' || page_id WHEN 1 THEN 'https://t.me/chan' || page_id || '/12' WHEN 2 THEN ' t.me/s/chan' || page_id WHEN 3 THEN 'https://t.me/' WHEN 4 THEN 'telegram.me/joinchat/x' ELSE url END"


@query("P13_channel_target", """SELECT page_id, page_id % 6 <> 5 AS is_channel,
  CASE page_id % 6 WHEN 3 THEN 'telegram_channel' WHEN 4 THEN 'joinchat' WHEN 5 THEN NULL ELSE 'chan' || page_id END AS name FROM pages""")
def p13(spark, d):
    return read(spark, d, "pages").select("page_id", U.channel_target(F.expr(TARGET)).alias("t")).select("page_id", "t.*")


VIDEO = "CASE page_id % 4 WHEN 0 THEN 'https://www.YouTube.com/watch?v=' || page_id WHEN 1 THEN 'https://youtu.be/' || page_id WHEN 2 THEN 'https://a.example.com/youtube.com' ELSE url END"


@query("P14_video_host", "SELECT page_id, page_id % 4 IN (0, 1) AS is_video FROM pages")
def p14(spark, d):
    return read(spark, d, "pages").select("page_id", U.is_video_host(F.expr(VIDEO)).alias("is_video"))


NAME_URL = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://a.example.com/dl.php?file=vol%20' || page_id || '.pdf&x=1' WHEN 2 THEN 'https://a.example.com/d/b%20' || page_id || '.epub' WHEN 3 THEN 'https://a.example.com' ELSE 'https://a.example.com/doc' END"
DISPOSITION = "CASE page_id % 6 WHEN 4 THEN 'attachment; filename=\"r ' || page_id || '.pdf\"' WHEN 5 THEN 'attachment; filename*=UTF-8' || chr(39) || chr(39) || '%D9%88' || page_id || '.pdf' END"


@query("P15_filename_from_url", """SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'vol ' || page_id || '.pdf' WHEN 2 THEN 'b ' || page_id || '.epub' WHEN 3 THEN 'unknown'
  WHEN 4 THEN 'r ' || page_id || '.pdf' WHEN 5 THEN 'و' || page_id || '.pdf'
  ELSE CASE WHEN regexp_extract(url, '://[^/?#]+[^?#]*/([^/?#]*)', 1) = '' THEN 'unknown' ELSE regexp_extract(url, '://[^/?#]+[^?#]*/([^/?#]*)', 1) END END AS name FROM pages""")
def p15(spark, d):
    disposition = F.expr(DISPOSITION)
    return read(spark, d, "pages").select("page_id", U.filename_from_url(F.expr(NAME_URL), disposition).alias("name"))


# --- pages with added markup: one expression, valid in both engines ----------

RICH = """'<html lang="ckb"><head><meta property="og:title" content=" Vol &amp; ' || page_id || ' "><meta name="author" content="Writer ' || (page_id % 7) || '">'
 || '<meta name="description" content="About ' || page_id || '"><meta itemprop="image" content="/m/' || page_id || '.jpg">'
 || '<link rel="stylesheet" href="/s.css"><link rel="alternate" href="/feed' || page_id || '.xml">'
 || '<script>var d = "https://cdn.example.com/r' || page_id || '.parquet"; var u = "ugd/w' || page_id || '.pdf"; load("https://a.example.com/no-file");</script>'
 || '<script type="application/ld+json">{"@type": "Book", "url": "https://books.example.com/b' || page_id || '", "nested": [{"documentUrl": "ugd/j' || page_id || '.pdf", "skip": "x"}, {"file": "rel' || page_id || '.epub"}]}</script></head>'
 || '<body><h1>Top &lt;' || page_id || '&gt;</h1><a href="/one.html">One ' || page_id || '</a><h2>Sub</h2><a title="T2" href="/two' || page_id || '.pdf">.</a>'
 || '<summary>Group A</summary><a href="three.zip?v=' || page_id || '">x</a><a href="#top">top</a><a href="/one.html">again</a>'
 || '<div data-href="/data' || page_id || '">Data link</div><button value="/btn' || page_id || '" onclick="go(' || chr(39) || '/click' || page_id || chr(39) || ')">b</button>'
 || '<form action="/form"><input type="image" src="/i.png"></form><iframe src="https://v.example.com/e' || page_id || '"></iframe>'
 || '<img src="/p' || page_id || '.jpg" srcset="/p1.jpg 1x, /p2.jpg 2x" data-src="/lazy.png"><div style="background-image:url(' || chr(39) || '/bg' || page_id || '.png' || chr(39) || ')"></div>'
 || '<main><p>First line.</p><p>First line.</p><p>Second line of page ' || page_id || '</p></main></body></html>'"""
def rich(spark, d):
    """Every page, whole and under its own URL, with the added markup after it."""
    return read(spark, d, "pages").select("page_id", "url", F.concat("html", F.expr(RICH)).alias("html"))


ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
#: Folder of a page's URL, where references without a slash start.
FOLDER = f"({ORIGIN} || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) END)"
#: The page's own anchors; they stand before its first heading.
ANCHOR = """'(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""
OWN_SQL = f"""own AS (SELECT page_id, {ORIGIN} || h[i] AS url, t[i] AS text, i FROM (SELECT page_id, url, unnest(range(1, len(h) + 1)) AS i, h, t
  FROM (SELECT page_id, url, regexp_extract_all(html, {ANCHOR}, 1) AS h, regexp_extract_all(html, {ANCHOR}, 2) AS t FROM pages)))"""


def _per_page(*values: str) -> str:
    """SQL rows (page_id, url) for the listed URL expressions."""
    return f"SELECT DISTINCT page_id, unnest([{', '.join(values)}]) AS url FROM pages"


def _with_own(*values: str) -> str:
    """The same, and the page's own links."""
    return f"WITH {OWN_SQL} {_per_page(*values)} UNION SELECT page_id, url FROM own"


@query("X1_html_metadata", """SELECT page_id, 'Vol & ' || page_id AS title, 'Writer ' || (page_id % 7) AS author, 'About ' || page_id AS description, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""")
def x1(spark, d):
    return rich(spark, d).select("page_id", H.html_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


UNESC = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("X1_page_titles", f"SELECT page_id, {UNESC.format('''trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1))''')} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM pages")
def x1b(spark, d):
    m = read(spark, d, "pages").select("page_id", H.html_metadata(F.col("html")).alias("m"))
    return m.select("page_id", "m.title", "m.language")


_STRIPPED = "html"
for _tag in rules.FURNITURE_TAGS:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
LINES_SQL = f"""
p0 AS (SELECT page_id, url, html, regexp_extract({_STRIPPED.replace('regexp_replace(html', "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", 1)}, '(?is)<article[^>]*>(.*?)</article>', 1) AS main FROM pages),
p1 AS (SELECT page_id, url, html, [x for x in [trim(regexp_replace({UNESC.format('y')}, '\\s+', ' ', 'g')) for y in string_split_regex(main, '<[^>]*>')] if x <> ''] AS raw FROM p0),
lines AS (SELECT page_id, url, html, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS lines FROM p1)"""


@query("X2_page_text_lines", f"WITH {LINES_SQL} SELECT page_id, unnest(lines) AS line FROM lines")
def x2(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(H.page_lines(F.col("html"))).alias("line"))


@query("X3_headings", """WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>', 1) AS t, regexp_extract_all(html, '(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>', 2) AS x FROM pages),
g AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, t, x FROM h)
SELECT page_id, CAST(i AS INTEGER) AS position, t[i] AS tag, """ + UNESC.format("trim(regexp_replace(x[i], '<[^>]*>', '', 'g'))") + " AS text FROM g")
def x3(spark, d):
    h = read(spark, d, "pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("position", "h"))
    return h.select("page_id", (F.col("position") + 1).alias("position"), "h.tag", "h.text")


@query("X4_page_links", f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
b AS (SELECT page_id, url, unnest(range(1, len(h) + 1)) AS i, h, t FROM a),
c AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h[i] AS url, t[i] AS text, i FROM b WHERE h[i] LIKE '/%')
SELECT page_id, url, arg_min(text, i) AS text FROM c GROUP BY page_id, url""")
def x4(spark, d):
    return LK.page_links(read(spark, d, "pages")).select("page_id", "url", "text")


@query("X4_link_context", f"""WITH {OWN_SQL} SELECT page_id, arg_min(url, i) AS url, 'anchor' AS kind, arg_min(text, i) AS text, '' AS heading, '' AS accordion_group, CASE WHEN length(arg_min(text, i)) > 2 THEN arg_min(text, i) ELSE 'Vol & ' || page_id END AS best_name FROM own GROUP BY page_id, own.url
UNION ALL SELECT page_id, url, kind, text, heading, accordion_group, best_name FROM (
  SELECT page_id, unnest([
    {{'url': {ORIGIN} || '/one.html', 'kind': 'anchor', 'text': 'One ' || page_id, 'heading': 'Top <' || page_id || '>', 'accordion_group': '', 'best_name': 'One ' || page_id}},
    {{'url': {ORIGIN} || '/two' || page_id || '.pdf', 'kind': 'anchor', 'text': '.', 'heading': 'Sub', 'accordion_group': '', 'best_name': 'T2'}},
    {{'url': {FOLDER} || 'three.zip?v=' || page_id, 'kind': 'anchor', 'text': 'x', 'heading': 'Sub', 'accordion_group': 'Group A', 'best_name': 'Sub'}},
    {{'url': {ORIGIN} || '/data' || page_id, 'kind': 'attribute', 'text': 'Data link', 'heading': '', 'accordion_group': '', 'best_name': 'Data link'}},
    {{'url': {ORIGIN} || '/form', 'kind': 'form', 'text': '', 'heading': '', 'accordion_group': '', 'best_name': ''}},
    {{'url': 'https://v.example.com/e' || page_id, 'kind': 'frame', 'text': '', 'heading': '', 'accordion_group': '', 'best_name': ''}}], recursive := true) FROM pages)""")
def x4b(spark, d):
    return LK.page_links(rich(spark, d)).select("page_id", "url", "kind", "text", "heading", "accordion_group", "best_name")


RESOURCES = [
    f"{ORIGIN} || '/m/' || page_id || '.jpg'", f"{ORIGIN} || '/feed' || page_id || '.xml'",
    "'https://cdn.example.com/r' || page_id || '.parquet'", "'https://usrfiles.com/ugd/w' || page_id || '.pdf'",
    "'https://books.example.com/b' || page_id", "'https://usrfiles.com/ugd/j' || page_id || '.pdf'",
    f"{FOLDER} || 'rel' || page_id || '.epub'", f"{ORIGIN} || '/i.png'", "'https://v.example.com/e' || page_id",
    f"{ORIGIN} || '/p' || page_id || '.jpg'", f"{ORIGIN} || '/p1.jpg'", f"{ORIGIN} || '/p2.jpg'", f"{ORIGIN} || '/lazy.png'",
    f"{ORIGIN} || '/bg' || page_id || '.png'",
]


@query("X5_resource_urls", _per_page(*RESOURCES))
def x5(spark, d):
    return LK.resource_urls(rich(spark, d))


_HREFS = f"h AS (SELECT page_id, regexp_extract_all(html, {ANCHOR}, 1) AS h, regexp_extract_all(html, {ANCHOR}, 2) AS t FROM pages)"


def _own_anchors(spark, d):
    """Targets and texts of a page's anchors as arrays."""
    pattern = F.lit(r"""(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>""")
    return read(spark, d, "pages").select("page_id", F.regexp_extract_all("html", pattern, 1).alias("h"), F.regexp_extract_all("html", pattern, 2).alias("t"))


@query("X6_srcset_split", f"""WITH {_HREFS}, e AS (SELECT page_id, unnest(h) AS target FROM h), c AS (SELECT page_id, unnest(string_split(target || '.jpg', ',')) AS url FROM e)
SELECT DISTINCT page_id, trim(url) AS url FROM c WHERE trim(url) <> ''""")
def x6(spark, d):
    # a set of sources made of the page's own targets; a comma in a target parts it
    value = F.array_join(F.transform("h", lambda h: F.concat(F.lit(" "), h, F.lit(".jpg 2x"))), ",")
    value = F.concat(value, F.lit(", data:xx"))
    return _own_anchors(spark, d).select("page_id", F.explode(H.srcset_urls(value)).alias("url")).distinct()


@query("X7_style_urls", f"""WITH {_HREFS}, e AS (SELECT page_id, unnest(h) AS target, generate_subscripts(h, 1) AS i FROM h)
SELECT DISTINCT page_id, CASE WHEN i % 2 = 1 THEN target || '.png' ELSE 'x ' || substring(target, 2) END AS url FROM e""")
def x7(spark, d):
    # the page's own targets, quoted and bare by turns
    rule = lambda h, i: F.when(i % 2 == 0, F.concat(F.lit('a:url("'), h, F.lit('.png");'))).otherwise(F.concat(F.lit("b:URL(x "), F.substring(h, F.lit(2), F.length(h)), F.lit("); c:url(data:zz);")))
    value = F.array_join(F.transform("h", rule), " ")
    return _own_anchors(spark, d).select("page_id", F.explode(H.style_urls(value)).alias("url")).distinct()


@query("X8_inline_script_urls", _per_page("'https://cdn.example.com/r' || page_id || '.parquet'"))
def x8(spark, d):
    bodies = rich(spark, d).select("page_id", F.explode(H.script_bodies(F.col("html"))).alias("body"))
    return bodies.select("page_id", F.explode(H.inline_urls(F.col("body"))).alias("url")).distinct()


@query("X9_json_urls", _per_page("'https://books.example.com/b' || page_id", "'https://usrfiles.com/ugd/j' || page_id || '.pdf'", f"{FOLDER} || 'rel' || page_id || '.epub'"))
def x9(spark, d):
    bodies = rich(spark, d).select("page_id", "url", F.explode(H.script_bodies(F.col("html"))).alias("body"))
    return bodies.select("page_id", F.explode(H.json_urls(F.col("body"), F.col("url"))).alias("url")).distinct()


@query("X10_interactive_links", _with_own(
    f"{ORIGIN} || '/one.html'", f"{ORIGIN} || '/two' || page_id || '.pdf'", f"{FOLDER} || 'three.zip?v=' || page_id",
    f"{ORIGIN} || '/data' || page_id", f"{ORIGIN} || '/btn' || page_id", f"{ORIGIN} || '/click' || page_id",
    f"{ORIGIN} || '/form'", "'https://v.example.com/e' || page_id").replace("SELECT page_id, url FROM own", "SELECT page_id, array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END for c in string_split(url, '')], '') FROM own"))
def x10(spark, d):
    return LK.interactive_links(rich(spark, d))


@query("X11_sitemap_locs", "SELECT page_id, url AS loc FROM pages UNION ALL SELECT page_id, 'https://m.example.com/' || page_id FROM pages")
def x11(spark, d):
    xml = F.expr("""'<urlset><url><loc> ' || url || ' </loc></url><url><LOC>https://m.example.com/' || page_id || '</LOC></url></urlset>'""")
    return read(spark, d, "pages").select("page_id", F.explode(H.sitemap_locs(xml)).alias("loc"))


QUALITY_SQL = LINES_SQL + f""",
f AS (SELECT page_id, url, html, lines, array_to_string(lines, chr(10)) AS text, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) AS title,
  len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS heads FROM lines),
w AS (SELECT *, len([x for x in string_split_regex(text, '\\s+') if x <> '']) AS words FROM f),
q AS (SELECT *, CASE WHEN words < 8 OR length(text) < 50 THEN 'too_short' WHEN {' OR '.join(f"contains(lower(regexp_replace(text, chr(10), ' ', 'g')), '{g}')" for g in rules.GATE_PHRASES)} THEN 'low_information_error_or_gate_page'
  WHEN title = '' AND heads = 0 THEN 'missing_page_identity' ELSE 'accepted' END AS reason FROM w)"""


@query("X12_page_quality", f"WITH {QUALITY_SQL} SELECT page_id, CASE WHEN reason = 'accepted' THEN 'accepted' ELSE 'rejected' END AS status, reason, words AS word_count, length(text) AS character_count, len(lines) AS line_count, CAST(0 AS DOUBLE) AS repeated_line_ratio, title <> '' AS has_title, heads AS heading_count FROM q")
def x12(spark, d):
    r = read(spark, d, "pages").select(
        "page_id", H.page_text(F.col("html")).alias("text"), H.title(F.col("html")).alias("title"), F.size(H.headings(F.col("html"))).alias("n")
    )
    return r.select("page_id", H.page_quality(F.col("text"), F.col("title"), F.col("n")).alias("q")).select("page_id", "q.*")


@query("X12_raw_line_repetition", r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT doc_id, len(list_distinct(l)) AS u, len([x for x in l if trim(x) <> '']) AS n FROM t)
SELECT doc_id, n AS line_count, CASE WHEN n > 0 THEN round_even(1.0 - CAST(u AS DOUBLE) / n, 4) ELSE 0 END AS repeated_line_ratio FROM c""")
def x12b(spark, d):
    doc = read(spark, d, "documents")
    q = doc.select("doc_id", H.page_quality(F.col("text"), F.lit("t"), F.lit(1)).alias("q"))
    return q.select("doc_id", "q.line_count", "q.repeated_line_ratio")


@query("X13_content_fingerprint", f"""WITH {QUALITY_SQL}, hd AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>', 1) AS t, regexp_extract_all(html, '(?is)<(h[1-6])[^>]*>(.*?)</h[1-6]>', 2) AS x FROM pages),
hj AS (SELECT page_id, [{{'tag': t[i], 'text': {UNESC.format("trim(regexp_replace(x[i], '<[^>]*>', '', 'g'))")}}} for i in range(1, len(t) + 1)] AS h FROM hd)
SELECT q.page_id, sha256(lower({UNESC.format('title')}) || chr(10) || text || chr(10) || CAST(to_json(h) AS VARCHAR)) AS fingerprint FROM q JOIN hj ON q.page_id = hj.page_id""")
def x13(spark, d):
    html = F.col("html")
    return read(spark, d, "pages").select(
        "page_id", H.content_fingerprint(H.title(html), H.page_text(html), H.headings(html)).alias("fingerprint")
    )


@query("X14_web_page_records")
def x14(spark, d):
    r = LK.web_page_records(read(spark, d, "pages"))
    return r.withColumns({"headings": F.to_json("headings"), "quality": F.to_json("quality"), "downloadable_files": F.to_json("downloadable_files")})


@query("X14_web_page_fields", f"""WITH {QUALITY_SQL} SELECT page_id, 'web_page.v2' AS schema_version, regexp_extract(url, '^([^#]*)', 1) AS canonical_url, {UNESC.format('title')} AS title,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, words AS word_count, reason = 'accepted' AS is_usable FROM q""")
def x14b(spark, d):
    return LK.web_page_records(read(spark, d, "pages")).select(
        "page_id", "schema_version", "canonical_url", "title", "language", "word_count", "is_usable"
    )


DOWNLOADS_SQL = f"""SELECT page_id, unnest([{{'url': {ORIGIN} || '/two' || page_id || '.pdf', 'title': 'T2', 'accordion_group': '', 'position': 1}},
  {{'url': {FOLDER} || 'three.zip?v=' || page_id, 'title': 'Sub', 'accordion_group': 'Group A', 'position': 2}}], recursive := true) FROM pages"""


@query("X15_A10_page_downloads", DOWNLOADS_SQL)
def x15(spark, d):
    r = LK.page_downloads(rich(spark, d)).select("page_id", F.posexplode("downloadable_files").alias("p", "f"))
    return r.select("page_id", "f.url", "f.title", "f.accordion_group", (F.col("p") + 1).alias("position"))


@query("A9_first_context", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1), 1) AS i FROM pages)
SELECT page_id, count(DISTINCT href) AS urls, min(i) - 1 AS first_position FROM a GROUP BY page_id""")
def a9(spark, d):
    l = LK.page_links(read(spark, d, "pages"))
    return l.groupBy("page_id").agg(F.count("url").alias("urls"), F.min("pos").alias("first_position"))


@query("W8_nearest_heading", """WITH t AS (SELECT page_id, generate_subscripts(m, 1) AS pos, unnest(m) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\s[^>]*>|<h[1-6][^>]*>.*?</h[1-6]>)', 1) AS m FROM pages)),
h AS (SELECT page_id, pos, CASE WHEN lower(tag) LIKE '<h%' THEN """ + UNESC.format("trim(regexp_replace(tag, '<[^>]*>', '', 'g'))") + """ END AS heading FROM t)
SELECT page_id, pos - 1 AS pos, last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS nearest_heading FROM h""")
def w8(spark, d):
    tokens = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<a\s[^>]*>|<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    t = read(spark, d, "pages").select("page_id", F.posexplode(tokens).alias("pos", "tag"))
    heading = F.when(F.lower("tag").startswith("<h"), F.trim(H.strip_tags(F.col("tag"))))
    t = t.select("page_id", F.col("pos").cast("long").alias("pos"), heading.alias("heading"), F.lit(None).cast("string").alias("accordion_group"))
    return LK.nearest_heading(t).select("page_id", "pos", "nearest_heading")


@query("M13_link_union", _with_own(*RESOURCES, f"{ORIGIN} || '/one.html'", f"{ORIGIN} || '/two' || page_id || '.pdf'",
                                   f"{FOLDER} || 'three.zip?v=' || page_id", f"{ORIGIN} || '/data' || page_id", f"{ORIGIN} || '/form'"))
def m13(spark, d):
    return LK.link_union(rich(spark, d))


@query("F6_usable_pages", f"WITH {QUALITY_SQL} SELECT page_id, words AS word_count FROM q WHERE reason = 'accepted'")
def f6(spark, d):
    return LK.usable_pages(LK.web_page_records(read(spark, d, "pages"))).select("page_id", "word_count")


@query("S12_record_names", f"""WITH {QUALITY_SQL}, s AS (SELECT page_id, sha256(text) AS digest, {UNESC.format('title')} AS t FROM q),
e AS (SELECT *, regexp_extract(t, '(?s)^\\.*[^.].*?(\\.[^.]*)$', 1) AS ext FROM s),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(substring(t, 1, length(t) - length(ext)), '[\\\\/:*?"<>|]', '_', 'g'), '[\\s\\-_]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS stem,
  lower(regexp_replace(regexp_replace(ext, '[\\\\/:*?"<>|]', '', 'g'), '^[ ._]+|[ ._]+$', '', 'g')) AS suffix FROM e)
SELECT page_id, substring(CASE WHEN stem = '' THEN 'unnamed' ELSE stem END || CASE WHEN suffix = '' THEN '' ELSE '.' || suffix END, 1, 80) || '_' || substring(digest, 1, 8) || '.json' AS name FROM c""")
def s12(spark, d):
    html = F.col("html")
    p = read(spark, d, "pages").select("page_id", H.title(html).alias("t"), F.sha2(H.page_text(html), 256).alias("digest"))
    return p.select("page_id", FN.record_name(F.col("t"), F.col("digest")).alias("name"))


@query("page_quality_by_domain", f"""WITH {QUALITY_SQL}
SELECT regexp_extract(regexp_extract(url, '://([^/?#:]+)', 1), '([^.]+\\.[^.]+)$', 1) AS domain, reason, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words FROM q GROUP BY ALL""")
def page_quality(spark, d):
    return LK.page_quality_by_domain(read(spark, d, "pages"))
