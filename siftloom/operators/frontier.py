"""Domain, pattern and robots joins, and the frontier expansion over a link table."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import urls
from siftloom.operators.patterns import pattern_matches
from siftloom.operators.skew import attach_per_key, with_positions
from siftloom.session import write_bucketed


def hosts_matching(hosts: DataFrame, domains: DataFrame, both_ways: bool = True) -> DataFrame:
    """Distinct hosts that match a domain table by dot-aligned suffix.

    Suffix tests become equality joins: a host's suffixes meet the domains, and
    for the reverse rule a domain's suffixes meet the hosts.
    """
    names = hosts.select("host").distinct().withColumn("_bare", urls.without_www(F.col("host")))
    listed = domains.select(urls.without_www(F.lower("domain")).alias("_domain")).distinct()
    down = (
        names.select("host", F.explode(urls.host_suffixes(F.col("_bare"))).alias("_domain"))
        .join(listed, "_domain", "left_semi")
        .select("host")
    )
    if not both_ways:
        return down.distinct()
    above = listed.select(F.explode(urls.host_suffixes(F.col("_domain"))).alias("_bare")).distinct()
    up = names.join(above, "_bare", "left_semi").select("host")
    return down.union(up).distinct()


def filter_allowed_hosts(
    rows: DataFrame, domains: DataFrame, cdns: DataFrame | None = None, url: str = "url"
) -> DataFrame:
    """Rows whose URL host is allowed by a domain table, or trusted by a CDN table.

    Hosts are matched once each; rows meet the matched hosts by equality.
    """
    hosted = rows.withColumn("host", urls.host(F.col(url)))
    hosts = hosted.select("host").where("host <> ''")
    ok = hosts_matching(hosts, domains)
    if cdns is not None:
        ok = ok.union(hosts_matching(hosts, cdns, both_ways=False)).distinct()
    counts = hosted.groupBy("host").agg(F.count("*").alias("_n"))
    listed = ok.join(counts, "host").withColumn("_ok", F.lit(True))
    # a host with very many rows is met by broadcast
    return attach_per_key(hosted, listed, ["host"], [url]).where("_ok").select(*rows.columns)


def matching_patterns(rows: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL matches any pattern of the table."""
    hit = pattern_matches(rows, patterns, url).select(F.col("url").alias("_url")).distinct()
    return rows.join(hit, F.col(url) == F.col("_url"), "left_semi")


# --- robots ------------------------------------------------------------------


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """One row per host with the ordered rules that bind ``agent``.

    ``robots``: host, status, body.  A body other than status 200 restricts nothing.
    Lines are numbered inside their host, whose size is that of its robots file.
    """
    lines = robots.where("status = 200").select(
        "host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "raw")
    )
    bare = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    field = F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    known = ["user-agent", "disallow", "allow", "crawl-delay", "request-rate"]
    lines = (
        lines.withColumn("line", bare)
        .withColumns({"field": field, "value": value})
        # comment-only lines are skipped; blank lines end a group
        .where((F.col("raw").rlike(r"^\s*$")) | F.col("field").isin(known))
    )
    in_order = Window.partitionBy("host").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    agent_line = F.col("field") == "user-agent"
    opens = agent_line & (F.coalesce(F.lag("field").over(in_order), F.lit("")) != "user-agent")
    # a blank line after rules closes the group: rules that follow belong to nobody
    lines = lines.withColumn("group_no", F.sum(F.when(opens, 1).otherwise(0)).over(so_far)).where(
        "group_no > 0"
    )
    in_group = Window.partitionBy("host", "group_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blanks = F.sum(F.when(F.col("field") == "", 1).otherwise(0)).over(in_group)
    lines = lines.withColumn("_blank", blanks).where("_blank = 0")
    path = F.when(F.col("value") == "", "").otherwise(
        urls.percent_encode_path(urls.percent_decode(F.col("value")))
    )
    groups = lines.groupBy("host", "group_no").agg(
        F.collect_list(F.when(agent_line, F.regexp_extract(F.lower("value"), r"^([^/]*)", 1))).alias("agents"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("field").isin("allow", "disallow"),
                    F.struct(
                        "pos",
                        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
                        path.alias("path"),
                    ),
                )
            )
        ).alias("rules"),
        F.max(~agent_line).alias("closed"),
    )
    token = agent.split("/")[0].lower()
    named = F.exists("agents", lambda a: (a != "*") & (a != "") & F.contains(F.lit(token), a))
    default = F.array_contains("agents", "*")
    groups = groups.withColumn(
        "_order", F.when(default, F.struct(F.lit(1), "group_no")).when(named, F.struct(F.lit(0), "group_no"))
    )
    return (
        groups.where("_order IS NOT NULL AND closed")
        .groupBy("host")
        .agg(F.min_by("rules", "_order").alias("rules"))
    )


def robots_allowed(
    rows: DataFrame, robots: DataFrame, agent: str = "Mozilla/5.0", enabled: bool = True, url: str = "url"
) -> DataFrame:
    """Rows with ``robots_allowed``.

    A host's rules travel as one array, so rows are not multiplied by rules; hosts
    with very many rows are resolved by broadcast.
    """
    if not enabled:
        return rows.withColumn("robots_allowed", F.lit(True))
    hosted = rows.withColumn("_host", urls.host(F.col(url)))
    counts = hosted.groupBy("_host").agg(F.count("*").alias("_n"))
    table = robots_rules(robots, agent).withColumnRenamed("host", "_host").join(counts, "_host")
    joined = attach_per_key(hosted, table, ["_host"], [url])
    full = F.concat(
        F.coalesce(urls.filled(urls.path(F.col(url))), F.lit("/")), F.regexp_extract(F.col(url), urls.SPLIT, 4)
    )
    joined = joined.withColumn("_target", urls.percent_encode_path(urls.percent_decode(full)))
    target = F.col("_target")
    first = F.try_element_at(
        F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(target, r["path"])), F.lit(1)
    )
    return joined.withColumn("robots_allowed", F.coalesce(first["allow"], F.lit(True))).drop("_host", "rules", "_target")


def sitemaps_for(hosts: DataFrame, robots: DataFrame) -> DataFrame:
    """(host, sitemap): advertised sitemaps, else the conventional one."""
    advertised = (
        robots.where("status = 200")
        .select("host", F.explode(F.split("body", r"\r?\n")).alias("line"))
        .where(F.col("line").rlike(r"(?i)^sitemap:"))
        .select("host", F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("sitemap"))
        .where("sitemap <> ''")
    )
    scheme = F.coalesce("scheme", F.lit("https")) if "scheme" in hosts.columns else F.lit("https")
    default = F.concat(scheme, F.lit("://"), F.col("host"), F.lit("/sitemap.xml"))
    return hosts.join(advertised, "host", "left").select(
        "host", F.coalesce("sitemap", default).alias("sitemap")
    )


def effective_domains(collectors: DataFrame) -> DataFrame:
    """(collector_id, domain): the configured list, else the hosts of the start URLs.

    Both lists come from one collector row, so no grouping is needed.
    """
    given = F.filter(
        F.transform("allowed_domains", lambda d: F.lower(F.trim(d))), lambda d: d != ""
    )
    derived = F.filter(
        F.array_distinct(F.transform("start_urls", lambda u: urls.host(u))), lambda h: h != ""
    )
    chosen = F.when(F.size(F.coalesce("allowed_domains", F.array().cast("array<string>"))) > 0, given).otherwise(derived)
    return collectors.select("collector_id", F.explode(chosen).alias("domain"))


# --- frontier ----------------------------------------------------------------


def prepare_edges(
    links: DataFrame,
    domains: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    extensions: Sequence[str] = (),
) -> DataFrame:
    """Distinct usable edges (src, dst, is_file) of a link table (page_url, url).

    All rules are applied here, once, so that the rounds only join.
    """
    dst = urls.normalize_url(urls.cloud_share_to_direct(F.col("url")), F.col("page_url"))
    edges = links.select(urls.normalize_url(F.col("page_url")).alias("src"), dst.alias("dst")).where(
        "src IS NOT NULL AND dst IS NOT NULL"
    )
    edges = edges.withColumn("is_file", urls.is_downloadable_url(F.col("dst"), extensions))
    target = F.col("dst")
    no_excluded = urls.passes_patterns(target, (), exclude)
    as_file = F.col("is_file") & urls.allowed_resource_domain(target, domains) & no_excluded
    as_page = (
        ~F.col("is_file")
        & urls.allowed_domain(target, domains)
        & ~urls.private_host(target)
        & urls.passes_patterns(target, include, exclude)
    )
    return edges.where(as_file | as_page).distinct()


def _leading(rows: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """First ``count`` rows in order, whatever the count, without one task that holds them."""
    return with_positions(rows, [F.col(c) for c in order], "_at_").where(F.col("_at_") <= count).drop("_at_")


def next_pages(edges: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """Distinct page targets of the pages at ``depth`` that are not among ``pages``."""
    last = pages.where(F.col("depth") == depth).select(F.col("url").alias("src"))
    found = edges.where(~F.col("is_file")).join(last, "src", "left_semi").select(F.col("dst").alias("url")).distinct()
    return found.join(pages.select("url"), "url", "left_anti")


def expand_frontier(
    links: DataFrame,
    start: DataFrame,
    domains: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    extensions: Sequence[str] = (),
    max_depth: int | None = None,
    max_pages: int | None = None,
    max_files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk of a link table: (pages: url, depth; files: url, depth, page_url).

    No URL is taken twice and files do not recurse.  Edges are written once, bucketed by
    their source, and the pages taken so far bucketed by URL, a partition per depth.  So a
    round reads the pages of the last depth and the edges that leave them bucket by bucket;
    only the targets found are shuffled, and they meet the pages seen before bucket by bucket
    again.  Lost executors read files and do not restart the walk.  Without ``max_depth`` the
    walk ends when a round finds nothing new.  Page and file budgets are filled in URL order
    within a round, by positions that many tasks number.
    """
    spark = links.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.table(write_bucketed(prepare_edges(links, domains, include, exclude, extensions), "src", buckets))
    first = start.select(urls.normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    if max_pages is not None:
        first = _leading(first, ["url"], max_pages)
    seen = write_bucketed(first.withColumn("depth", F.lit(0)), "url", buckets, partition="depth")
    for depth in itertools.count() if max_depth is None else range(max_depth):
        pages = spark.table(seen)
        step = next_pages(edges, pages, depth)
        if max_pages is not None:
            step = _leading(step, ["url"], max_pages - pages.count())
        write_bucketed(step.withColumn("depth", F.lit(depth + 1)), "url", buckets, seen, "depth")
        if spark.table(seen).where(F.col("depth") == depth + 1).isEmpty():
            break
    pages = spark.table(seen)
    reached = pages if max_depth is None else pages.where(F.col("depth") < max_depth)
    sources = reached.select(F.col("url").alias("src"), "depth")
    files = (
        edges.where("is_file")
        .join(sources, "src")
        .groupBy(F.col("dst").alias("url"))
        .agg(F.min(F.struct("depth", F.col("src").alias("page_url"))).alias("at"))
        .select("url", "at.depth", "at.page_url")
    )
    if max_files is not None:
        files = _leading(files, ["depth", "url"], max_files)
    return pages, files
