"""Links, resources and records of captured pages.

Every operator keeps a page's HTML inside its own row; only link rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import html as H
from siftloom.functions import urls
from siftloom.functions.text import strip


def _link(href: Column, kind: Column, rank: Column, pos: Column, **context: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        href.alias("href"),
        kind.alias("kind"),
        F.struct(rank.alias("rank"), pos.cast("long").alias("pos")).alias("at"),
        *[context.get(n, empty).alias(n) for n in ("text", "title_attr", "heading", "accordion_group")],
    )


def _anchor_links(html: Column) -> Column:
    def of_section(section: Column, s: Column) -> Column:
        def of_anchor(a: Column, i: Column) -> Column:
            tag = F.regexp_extract(a, r"(?s)^<[^>]*>", 0)
            label = F.coalesce(urls.filled(H.raw_attribute(tag, "title")), H.raw_attribute(tag, "aria-label"))
            return _link(
                H.raw_attribute(tag, "href"), F.lit("anchor"), F.lit(0), s.cast("long") * 1_000_000 + i,
                text=H.without_tags(a), title_attr=label,
                heading=section["heading"], accordion_group=section["accordion_group"],
            )

        return F.transform(H.anchors(section["html"]), of_anchor)

    return F.flatten(F.transform(H.sections(html), of_section))


def _attribute_links(html: Column) -> Column:
    """Links in data attributes, with the text that directly follows the tag."""
    names = "|".join(rules.LINK_ATTRIBUTES)
    known = urls.literal_array(rules.LINK_ATTRIBUTES)
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)(<[a-z][a-z0-9]*\s[^<>]*\b(?:{names})\s*=[^<>]*>[^<]*)"), 1)

    def of_tag(t: Column, i: Column) -> Column:
        found = F.filter(H.tag_attributes(t), lambda a: F.array_contains(known, a["name"]))
        return F.transform(
            found,
            lambda a: _link(
                urls.expand_document_id(a["value"]), F.lit("attribute"),
                F.array_position(known, a["name"]).cast("int"), i, text=H.without_tags(t),
            ),
        )

    return F.flatten(F.transform(tags, of_tag))


def _tag_links(html: Column) -> Column:
    """Form targets and frame sources."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:form|iframe|embed|frame)\s[^>]*>)"), 1)
    form = lambda t: t.rlike("(?i)^<form")
    return F.transform(
        tags,
        lambda t, i: _link(
            H.unquote(
                F.regexp_extract(t, r"(?is)(?:^<form\s(?:[^>]*?\s)?action|^<(?!form)[a-z]+\s(?:[^>]*?\s)?src)\s*=\s*" + H._RAW_VALUE, 1)
            ),
            F.when(form(t), "form").otherwise("frame"), F.when(form(t), 10).otherwise(11), i,
        ),
    )


def all_links(html: Column) -> Column:
    """Every link of a page with its target as written, in order of precedence."""

    def collect(clean: Column) -> Column:
        links = F.concat(_anchor_links(clean), _attribute_links(clean), _tag_links(clean))
        return F.filter(F.transform(links, decode), lambda link: urls.is_navigational(link["href"]))

    def decode(link: Column) -> Column:
        plain = lambda name: strip(H.unescape(link[name])).alias(name)
        return F.struct(
            H.unescape(link["href"]).alias("href"), link["kind"].alias("kind"), link["at"].alias("at"),
            plain("text"), plain("title_attr"), link["heading"].alias("heading"),
            link["accordion_group"].alias("accordion_group"),
        )

    return urls.let(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), collect)


def _best_name(text: Column, title_attr: Column, heading: Column, page_title: Column) -> Column:
    return (
        F.when(F.length(text) > 2, text)
        .when(title_attr != "", title_attr)
        .when(heading != "", heading)
        .otherwise(F.coalesce(page_title, F.lit("")))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per page and absolute URL, with the context of its first occurrence."""
    rows = pages.select(
        "page_id",
        F.col("url").alias("page_url"),
        H.title(F.col("html")).alias("page_title"),
        F.explode(all_links(F.col("html"))).alias("link"),
    )
    rows = rows.select(
        "page_id", "page_url", "page_title", "link.*",
        urls.resolve_relative(F.col("page_url"), F.col("link.href")).alias("url"),
    )
    return first_context(rows).withColumn(
        "best_name",
        F.when(
            F.col("kind") == "attribute",
            F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("page_title", F.lit(""))),
        )
        .when(F.col("kind") == "anchor", _best_name(*[F.col(c) for c in ("text", "title_attr", "heading", "page_title")]))
        .otherwise(""),
    )


def first_context(links: DataFrame) -> DataFrame:
    """First context of each URL on each page, by (kind, position).

    The rows of a page sit in one task, so most repeats go before the shuffle.
    """
    fields = ["page_url", "page_title", "kind", "text", "title_attr", "heading", "accordion_group"]
    first = links.groupBy("page_id", "url").agg(
        F.min_by(F.struct(*fields, F.col("at.rank").alias("kind_rank"), F.col("at.pos").alias("pos")), "at").alias("c")
    )
    return first.select("page_id", "url", "c.*")


def nearest_heading(tokens: DataFrame) -> DataFrame:
    """Last heading and accordion label at or before each token of a page.

    ``tokens``: page_id, pos, heading, accordion_group (NULL where the token is not
    one).  A page bounds its group.
    """
    so_far = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumns(
        {
            "nearest_heading": F.last("heading", ignorenulls=True).over(so_far),
            "nearest_accordion": F.last("accordion_group", ignorenulls=True).over(so_far),
        }
    )


# --- resources ---------------------------------------------------------------


def _tag_resources(html: Column) -> Column:
    pairs = urls.literal_array([f"{tag} {attr}" for tag, attr in rules.RESOURCE_TAG_ATTRIBUTES])
    data_names = urls.literal_array(rules.RESOURCE_DATA_ATTRIBUTES)
    metas = [rf"\s{key}\s*=\s*[\"']{name}[\"']" for key, name in rules.RESOURCE_META_KEYS]

    def of_tag(tag: Column) -> Column:
        def wanted(x: Column, a: Column) -> Column:
            return (
                F.array_contains(pairs, F.concat(x["name"], F.lit(" "), a["name"]))
                | F.array_contains(data_names, a["name"])
                | ((x["name"] == "link") & (a["name"] == "href") & x["link"])
                | ((x["name"] == "meta") & (a["name"] == "content") & x["meta"])
                | ((x["name"] == "input") & (a["name"] == "src") & x["image"])
            )

        def pick(x: Column) -> Column:
            kept = F.filter(x["attrs"], lambda a: wanted(x, a) & ~a["value"].startswith("data:"))
            return F.flatten(F.transform(kept, lambda a: H.srcset_urls(H.unescape(a["value"]))))

        rel = F.lower(strip(H.raw_attribute(tag, "rel")))
        facts = F.struct(
            H.tag_name(tag).alias("name"),
            H.tag_attributes(tag).alias("attrs"),
            (
                urls.let(rel, lambda r: r.isin(rules.ENCLOSURE_RELS) | r.contains("image_src"))
                | F.lower(strip(H.raw_attribute(tag, "as"))).isin(rules.ENCLOSURE_AS)
            ).alias("link"),
            tag.rlike("(?i)" + "|".join(metas)).alias("meta"),
            tag.rlike(r"(?i)\stype\s*=\s*[\"']?image[\"'\s/>]").alias("image"),
        )
        return urls.let(facts, pick)

    # tags that cannot hold a resource are skipped before their attributes are read
    candidates = F.filter(
        H.start_tags(html),
        lambda t: t.rlike(
            r"(?i)^<(?:img|source|video|audio|iframe|embed|object|image|use|input|link|meta)\s|\sdata-"
        ),
    )
    return F.flatten(F.transform(candidates, of_tag))


def resource_urls(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, url) of everything a page points to besides plain anchors."""
    html, base = F.col("html"), F.col("page_url")
    styles = F.regexp_extract_all(
        html, F.lit(r"(?is)<[a-z][a-z0-9]*\s(?:[^>]*?\s)?style\s*=\s*(\"[^\"]*url[^\"]*\"|'[^']*url[^']*')"), 1
    )
    relative = F.concat(
        F.transform(_tag_resources(html), urls.expand_document_id),
        F.flatten(
            F.transform(styles, lambda s: H.style_urls(H.unescape(H.unquote(s))))
        ),
    )
    absolute = F.flatten(
        F.transform(
            H.script_bodies(html),
            lambda b: F.concat(H.inline_urls(b), H.inline_document_ids(b), H.json_urls(b, base)),
        )
    )
    found = F.array_distinct(
        F.concat(F.transform(relative, lambda u: urls.resolve_relative(base, u)), absolute)
    )
    # targets are unique within the page's own row, and page ids are unique
    return pages.select("page_id", F.col("url").alias("page_url"), "html").select(
        "page_id", F.explode(found).alias("url")
    )


def link_union(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, url) over links and resources."""
    return page_links(pages).select("page_id", "url").unionByName(resource_urls(pages)).distinct()


def interactive_links(pages: DataFrame) -> DataFrame:
    """Distinct normalised (page_id, url) of anchors, buttons, click handlers, forms and frames."""
    html = F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->", "")

    def values(tag: Column) -> Column:
        name = H.tag_name(tag)
        attrs = H.tag_attributes(tag)
        direct = F.filter(
            attrs,
            lambda a: (
                (a["name"].isin("data-href", "data-url", "data-link", "value") & a["value"].rlike(r"^(?:https?://|/)"))
                | ((name == "a") & (a["name"] == "href") & ~a["value"].rlike(r"^(?:javascript:|mailto:|tel:|#)"))
                | (
                    ~a["value"].rlike(r"^(?:javascript:|#)")
                    & (
                        ((name == "form") & (a["name"] == "action"))
                        | (name.isin("iframe", "embed") & (a["name"] == "src"))
                        | ((name == "object") & (a["name"] == "data"))
                    )
                )
            ),
        )
        clicks = F.filter(attrs, lambda a: a["name"] == "onclick")
        return F.concat(
            F.transform(direct, lambda a: H.unescape(a["value"])),
            F.flatten(F.transform(clicks, lambda a: H.onclick_urls(H.unescape(a["value"])))),
        )

    raw = F.array_distinct(F.flatten(F.transform(H.start_tags(html), values)))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.explode(raw).alias("href"))
    return (
        rows.where("href <> ''")
        .select("page_id", urls.normalize_url(F.col("href"), F.col("page_url")).alias("url"))
        .where("url IS NOT NULL")
        .distinct()
    )


# --- records -----------------------------------------------------------------


def _downloadables(page_url: Column, page_title: Column, html: Column) -> Column:
    """Downloadable links of a page, first occurrence per URL, inside the row."""
    kinds = urls.alternation(rules.PAGE_DOWNLOAD_EXTENSIONS)
    candidates = F.filter(all_links(html), lambda link: link["href"].rlike(rf"(?i)(?:{kinds})(?:[?#]|$)"))
    named = F.transform(
        candidates,
        lambda link: F.struct(
            urls.resolve_relative(page_url, link["href"]).alias("url"),
            F.when(
                link["kind"] == "anchor",
                _best_name(link["text"], link["title_attr"], link["heading"], page_title),
            )
            .when(
                link["kind"] == "attribute",
                F.when(link["text"] != "", link["text"]).otherwise(F.coalesce(page_title, F.lit(""))),
            )
            .otherwise("")
            .alias("title"),
            link["accordion_group"].alias("accordion_group"),
        ),
    )
    # the raw target decides most cases before anything is resolved or named
    wanted = F.filter(
        named,
        lambda link: urls.ends_with_any(
            F.lower(F.regexp_extract(link["url"], r"^([^?#]*)", 1)), rules.PAGE_DOWNLOAD_EXTENSIONS
        ),
    )
    return urls.let(wanted, _first_of_each_url)


def _first_of_each_url(links: Column) -> Column:
    """Links without repeats of a URL, in their order; sorted once instead of compared pairwise."""
    ordered = F.array_sort(F.transform(links, lambda link, i: F.struct(link["url"].alias("url"), i.alias("i"))))

    def firsts(x: Column) -> Column:
        new = F.filter(x, lambda p, k: (k == 0) | ~p["url"].eqNullSafe(F.get(x, k - 1)["url"]))
        return F.array_sort(F.transform(new, lambda p: p["i"]))

    return F.transform(urls.let(ordered, firsts), lambda i: F.get(links, i))


def page_downloads(pages: DataFrame) -> DataFrame:
    """One row per page with its ordered list of downloadable files.  No shuffle."""
    page = pages.select("page_id", "url", "html", H.title(F.col("html")).alias("title"))
    return page.select(
        "page_id",
        _downloadables(F.col("url"), F.col("title"), F.col("html")).alias("downloadable_files"),
    )


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once, whoever reads them: filters and projections do not repeat a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def web_page_records(pages: DataFrame) -> DataFrame:
    """``web_page.v2`` records: one narrow plan from HTML to record.

    Text, metadata and verdict are computed once per row and reused by the later members
    and by filters on the records.
    """
    html = F.col("html")
    staged = _once(
        pages.select("page_id", "url", "html"),
        meta=H.html_metadata(html), body_text=H.page_text(html), headings=H.headings(html),
    )
    text, title = F.col("body_text"), F.col("meta.title")
    staged = _once(staged, quality=H.page_quality(text, title, F.size("headings")))
    staged = staged.withColumns(
        {
            "host_parts": urls.split_host(F.col("url")),
            "content_fingerprint": H.content_fingerprint(title, text, F.col("headings")),
            "downloadable_files": _downloadables(F.col("url"), title, html),
        }
    )
    return staged.select(
        "page_id",
        F.lit("web_page.v2").alias("schema_version"),
        F.lit("web_page").alias("record_type"),
        "url",
        F.regexp_extract("url", r"^([^#]*)", 1).alias("canonical_url"),
        F.col("host_parts.domain").alias("source_domain"),
        F.col("host_parts.subdomain").alias("source_subdomain"),
        F.col("host_parts.route").alias("source_route"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.coalesce("meta.description", F.lit("")).alias("description"),
        F.coalesce("meta.author", F.lit("")).alias("author"),
        F.coalesce("meta.language", F.lit("ku")).alias("language"),
        "headings",
        "body_text",
        F.col("quality.word_count").alias("word_count"),
        "content_fingerprint",
        "quality",
        (F.col("quality.status") == "accepted").alias("is_usable"),
        "downloadable_files",
    )


def usable_pages(records: DataFrame) -> DataFrame:
    """Records worth keeping: text present, usable and not rejected."""
    return records.where(
        (strip(F.col("body_text")) != "")
        & F.coalesce("is_usable", F.lit(True))
        & (F.coalesce("quality.status", F.lit("accepted")) != "rejected")
    )


def page_quality_by_domain(pages: DataFrame) -> DataFrame:
    """Pages per domain and verdict: the smallest end-to-end report."""
    html = F.col("html")
    staged = pages.select(
        urls.split_host(urls.normalize_url(F.col("url")))["domain"].alias("domain"),
        H.title(html).alias("title"),
        H.page_text(html).alias("text"),
        F.size(H.headings(html)).alias("n_headings"),
    )
    judged = staged.select(
        "domain", H.page_quality(F.col("text"), F.col("title"), F.col("n_headings")).alias("q")
    )
    return judged.groupBy("domain", F.col("q.reason").alias("reason")).agg(
        F.count("*").alias("pages"), F.sum("q.word_count").alias("words")
    )
