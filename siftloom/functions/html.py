"""HTML and JSON extraction as column expressions.

Pages are cut with regular expressions over one string column, so a page never
leaves its row and never enters a Python worker.  Tags need not balance: script
bodies go first and text is split at every tag.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import urls
from siftloom.functions.text import collapse, strip, word_count

_RAW_VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_COMMENT = r"(?s)<!--.*?-->"

#: Named references of HTML 4 by the standard library's table, as one constant map; the
#: ampersand is decoded last and stays out.
_NAMED = ",".join(
    f"{name}:{chr(point)}" for name, point in sorted({**name2codepoint, "apos": 39}.items()) if name != "amp"
)


def unescape(text: Column) -> Column:
    """Decode the named references of HTML 4 and all numeric character references."""

    def decode_one(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"(?i)^&#x?([0-9a-f]+);$", 1)
        point = F.when(ref.rlike(r"^&#[xX]"), digits).otherwise(F.conv(digits, 10, 16))
        return F.replace(acc, ref, F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32"))

    def numeric(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(r"(&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});)"), 1)
        return F.when(t.contains("&#"), F.aggregate(F.array_distinct(found), t, decode_one)).otherwise(t)

    def named(t: Column) -> Column:
        table = F.str_to_map(F.lit(_NAMED), F.lit(","), F.lit(":"))

        def piece(p: Column, i: Column) -> Column:
            name = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1)
            known = F.when(name != "", F.try_element_at(table, name))
            decoded = F.concat(known, F.regexp_replace(p, "^[A-Za-z0-9]+;", ""))
            return F.when(i == 0, p).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), p)))

        return F.array_join(F.transform(F.split(t, "&"), piece), "")

    return urls.let(
        text,
        lambda t: F.when(
            t.contains("&"), F.replace(urls.let(named(t), numeric), F.lit("&amp;"), F.lit("&"))
        ).otherwise(t),
    )


def unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of one attribute inside a start tag, references not decoded; '' when absent."""
    return unquote(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{_RAW_VALUE}", 1))


def attribute(tag: Column, name: str) -> Column:
    return unescape(raw_attribute(tag, name))


def without_tags(fragment: Column) -> Column:
    return F.regexp_replace(fragment, r"(?s)<[^>]*>", "")


def strip_tags(fragment: Column) -> Column:
    return unescape(without_tags(fragment))


# --- metadata, headings, text ------------------------------------------------


def _meta_tags(html: Column, key: str, names: list[str]) -> Column:
    wanted = "|".join(n.replace(".", r"\.") for n in names)
    return F.regexp_extract(html, rf"(?is)<meta\b[^>]*\s{key}\s*=\s*[\"']?(?:{wanted})[\"'\s/>][^>]*>", 0)


def _meta(html: Column, key: str, names: list[str]) -> Column:
    return urls.filled(strip(attribute(_meta_tags(html, key, names), "content")))


def title(html: Column) -> Column:
    head = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.coalesce(
        _meta(html, "property", ["og:title"]),
        _meta(html, "name", ["DC.title", "citation_title"]),
        urls.filled(strip(unescape(head))),
    )


def html_metadata(html: Column) -> Column:
    """struct(title, author, description, language); absent members are NULL."""

    def read(h: Column) -> Column:
        root = F.regexp_extract(h, r"(?is)<html\b[^>]*>", 0)
        return F.struct(
            title(h).alias("title"),
            _meta(h, "name", ["author", r"DC.creator", "citation_author"]).alias("author"),
            F.coalesce(
                _meta(h, "name", ["description"]), _meta(h, "property", ["og:description"])
            ).alias("description"),
            urls.filled(strip(attribute(root, "lang"))).alias("language"),
        )

    return urls.let(html, read)


def headings(html: Column) -> Column:
    """array<struct<tag,text>> of h1 to h6 with text, in document order."""
    pattern = r"(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]\s*>"
    levels = F.regexp_extract_all(html, F.lit(pattern), 1)
    texts = F.regexp_extract_all(html, F.lit(pattern), 2)
    pairs = F.zip_with(
        levels,
        texts,
        lambda n, t: F.struct(
            F.concat(F.lit("h"), n).alias("tag"), strip(strip_tags(t)).alias("text")
        ),
    )
    return F.filter(pairs, lambda h: h["text"] != "")


def _class_test(names: list[str]) -> str:
    wanted = "|".join(names)
    return rf"\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:{wanted})(?:\s[^\"']*)?[\"']"


_VOID = "area base br col embed hr img input link meta source track wbr".split()


def _pieces(html: Column) -> Column:
    """Tags and texts of a page in order: array<struct<t, name, step, skip>>.

    ``step`` is 1 for a start tag, -1 for an end tag and 0 otherwise; ``skip`` marks start
    tags of page furniture, options and buttons.  Comments, scripts and styles are left out.
    """
    body = F.regexp_replace(F.regexp_replace(html, _COMMENT, ""), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    cut = F.regexp_extract_all(body, F.lit(r"(?s)(<[a-zA-Z/!?][^>]*>|[^<]+|<)"), 1)
    furniture = urls.literal_array([*rules.FURNITURE_TAGS, "option", "button"])

    def describe(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))

        def with_name(n: Column) -> Column:
            step = (
                F.when((n == "") | n.isin(_VOID) | F.endswith(t, F.lit("/>")), 0)
                .when(F.startswith(t, F.lit("</")), -1).otherwise(1)
            )
            skip = (step == 1) & (F.array_contains(furniture, n) | t.rlike(rf"(?is){_class_test(rules.FURNITURE_CLASSES)}"))
            return F.struct(t.alias("t"), n.alias("name"), step.alias("step"), skip.alias("skip"))

        return urls.let(name, with_name)

    return F.transform(cut, describe)


def _without_skipped(pieces: Column) -> Column:
    """Pieces outside skipped elements; an element ends at its own end tag, however deep.

    One pass writes a mark per piece; an element that is never closed reaches to the end.
    """
    start = F.struct(F.lit("").alias("marks"), F.lit("").alias("inside"), F.lit(0).alias("depth"))

    def step(acc: Column, x: Column) -> Column:
        depth = F.when(acc["inside"] == "", F.when(x["skip"], 1).otherwise(0)).otherwise(
            acc["depth"] + F.when(x["name"] == acc["inside"], x["step"]).otherwise(0)
        )
        return F.struct(
            F.concat(acc["marks"], F.when((acc["inside"] == "") & ~x["skip"], "1").otherwise("0")).alias("marks"),
            F.when(depth <= 0, "").when(acc["inside"] == "", x["name"]).otherwise(acc["inside"]).alias("inside"),
            F.greatest(depth, F.lit(0)).alias("depth"),
        )

    marks = F.split(F.aggregate(pieces, start, step)["marks"], "")
    return F.filter(F.transform(F.arrays_zip(pieces.alias("p"), marks.alias("m")), lambda z: F.when(z["m"] == "1", z["p"])), lambda p: p.isNotNull())


def _inside(pieces: Column, at: Column) -> Column:
    """Pieces between the start tag at position ``at`` (from 1) and its own end tag, or the end."""
    name = F.get(pieces, at - 1)["name"]
    rest = F.slice(pieces, at + 1, F.greatest(F.size(pieces), F.lit(1)))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("count"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x["name"] == name, x["step"]).otherwise(0)
        return F.when(acc["depth"] <= 0, acc).otherwise(
            F.struct(depth.alias("depth"), (acc["count"] + F.when(depth > 0, 1).otherwise(0)).alias("count"))
        )

    return F.slice(rest, F.lit(1), F.aggregate(rest, start, step)["count"])


def _container(pieces: Column) -> Column:
    """Pieces inside the first preferred text container, else the body, else after the head."""

    def place(test) -> Column:
        return F.nullif(F.array_position(F.transform(pieces, lambda x: (x["step"] == 1) & test(x)), True), F.lit(0))

    found = []
    for kind, name in rules.MAIN_CONTAINERS:
        if kind == "tag":
            found.append(place(lambda x, n=name: x["name"] == n))
        elif kind == "id":
            found.append(place(lambda x, n=name: x["t"].rlike(rf"(?is)\sid\s*=\s*[\"']?{n}[\"'\s>]")))
        else:
            found.append(place(lambda x, n=name: x["t"].rlike(rf"(?is){_class_test([n])}")))
    at = F.coalesce(*found, place(lambda x: x["name"] == "body")).cast("int")
    head = F.array_position(F.transform(pieces, lambda x: (x["step"] == -1) & (x["name"] == "head")), True).cast("int")
    bare = F.slice(pieces, head + 1, F.greatest(F.size(pieces), F.lit(1)))
    return urls.let(at, lambda i: F.when(i.isNull(), bare).otherwise(_inside(pieces, i)))


def page_lines(html: Column, distinct: bool = True) -> Column:
    """Readable lines of a page; one per stretch of text between tags."""
    inner = urls.let(urls.let(_pieces(html), _without_skipped), _container)
    texts = F.filter(inner, lambda x: ~F.startswith(x["t"], F.lit("<")))
    lines = F.filter(F.transform(texts, lambda x: collapse(unescape(x["t"]))), lambda p: p != "")
    return F.array_distinct(lines) if distinct else lines


def page_text(html: Column) -> Column:
    return F.array_join(page_lines(html), "\n")


# --- page verdict and fingerprint -------------------------------------------


def page_quality(text: Column, page_title: Column, heading_count: Column) -> Column:
    """Verdict on readable text: status, reason and the counts behind it."""
    none = F.array().cast("array<string>")
    lines = F.when(text == "", none).otherwise(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))
    facts = F.struct(
        word_count(text).alias("words"),
        F.length(text).alias("chars"),
        urls.let(
            lines,
            lambda x: F.struct(
                F.size(F.filter(x, lambda line: line.rlike(r"(?U)\S"))).alias("filled"),
                F.size(F.array_distinct(x)).alias("unique"),
            ),
        ).alias("lines"),
        F.lower(collapse(text)).rlike(urls.alternation(rules.GATE_PHRASES)).alias("gate"),
        (strip(F.coalesce(page_title, F.lit(""))) != "").alias("has_title"),
        heading_count.alias("headings"),
    )
    return urls.let(facts, _verdict)


def _verdict(x: Column) -> Column:
    filled = x["lines"]["filled"]
    repeated = F.when(filled > 0, 1.0 - x["lines"]["unique"] / filled).otherwise(0.0)
    reason = (
        F.when((x["words"] < 8) | (x["chars"] < 50), "too_short")
        .when(x["gate"], "low_information_error_or_gate_page")
        .when(repeated > 0.35, "repetitive_boilerplate")
        .when(~x["has_title"] & (x["headings"] == 0), "missing_page_identity")
        .otherwise("accepted")
    )
    return F.struct(
        F.when(reason == "accepted", "accepted").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        x["words"].alias("word_count"),
        x["chars"].alias("character_count"),
        filled.alias("line_count"),
        F.bround(repeated, 4).alias("repeated_line_ratio"),
        x["has_title"].alias("has_title"),
        x["headings"].alias("heading_count"),
    )


def content_fingerprint(page_title: Column, text: Column, heads: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "\n",
            F.lower(strip(F.coalesce(page_title, F.lit("")))),
            F.coalesce(text, F.lit("")),
            F.to_json(F.coalesce(heads, F.array().cast("array<struct<tag:string,text:string>>"))),
        ),
        256,
    )


# --- links -------------------------------------------------------------------


def _marker() -> str:
    """Start of a heading-like or accordion-like element that is not inside an anchor."""
    outside = r"(?!(?:<(?!/?a[\s>])[^<]*+)*+</a[\s>])"
    return "(?i)(?:" + _marker_start() + ")" + outside


def _marker_start() -> str:
    return (
        r"(?=<h[1-6][\s>])|(?=<strong[\s>])|(?=<summary[\s>])|(?=<[a-z][a-z0-9]*\b[^>]*"
        + _class_test(rules.HEADING_CLASSES + rules.ACCORDION_CLASSES)
        + r")|(?=<[a-z][a-z0-9]*\b[^>]*\sdata-(?:bs-)?toggle\s*=\s*[\"']collapse[\"'])"
    )


def sections(html: Column) -> Column:
    """Page cut at headings and accordion headers.

    Each piece carries the nearest heading and accordion label that starts at or
    before it, so links can be given context without comparing rows.
    """
    accordion = (
        r"(?is)^<(?:summary[\s>]|[a-z][a-z0-9]*\b[^>]*(?:"
        + _class_test(rules.ACCORDION_CLASSES)
        + r"|\sdata-(?:bs-)?toggle\s*=\s*[\"']collapse[\"']))"
    )
    heading = (
        r"(?is)^<(?:h[1-6][\s>]|strong[\s>]|[a-z][a-z0-9]*\b[^>]*"
        + _class_test(rules.HEADING_CLASSES)
        + ")"
    )

    def mark(p: Column) -> Column:
        label = strip(strip_tags(F.regexp_extract(p, r"(?is)^<([a-z][a-z0-9]*)[^>]*>(.*?)</\1\s*>", 2)))
        return urls.let(
            F.when(p.startswith("<"), label),
            lambda t: F.struct(
                p.alias("html"),
                F.when((F.length(t) > 2) & p.rlike(heading), t).alias("h"),
                F.when((F.length(t) > 2) & p.rlike(accordion), t).alias("a"),
            ),
        )

    def index(m: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(m) - 1)
        return F.struct(
            m.alias("m"),
            F.filter(at, lambda i: F.get(m, i)["h"].isNotNull()).alias("h"),
            F.filter(at, lambda i: F.get(m, i)["a"].isNotNull()).alias("a"),
        )

    def carried(x: Column, field: str) -> Column:
        """Last label at or before each piece: every label is repeated up to the next one."""
        ends = F.size(x["m"])
        before = F.array_repeat(F.lit(""), F.coalesce(F.get(x[field], F.lit(0)), ends))
        runs = F.transform(
            x[field], lambda j, k: F.array_repeat(F.get(x["m"], j)[field], F.coalesce(F.get(x[field], k + 1), ends) - j)
        )
        return F.concat(before, F.flatten(runs))

    def spread(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), carried(x, "h").alias("h"), carried(x, "a").alias("a"))

    def label(x: Column) -> Column:
        return F.transform(
            x["m"],
            lambda m, i: F.struct(
                m["html"].alias("html"),
                F.get(x["h"], i).alias("heading"),
                F.get(x["a"], i).alias("accordion_group"),
            ),
        )

    pieces = F.split(F.regexp_replace(html, _COMMENT, ""), _marker())
    return urls.let(urls.let(urls.let(F.transform(pieces, mark), index), spread), label)


ANCHOR = r"(?is)(<a\s[^>]*>.*?</a\s*>)"
START_TAG = r"(?is)(<[a-z][a-z0-9]*\s[^>]*>)"


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(ANCHOR), 1)


def start_tags(html: Column) -> Column:
    """Every start tag that has attributes."""
    return F.regexp_extract_all(F.regexp_replace(html, _COMMENT, ""), F.lit(START_TAG), 1)


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([A-Za-z][A-Za-z0-9]*)", 1))


def tag_attributes(tag: Column) -> Column:
    """array<struct<name,value>> of one start tag, references not decoded."""
    pattern = rf"(?is)\s([a-z][a-z0-9:_-]*)\s*=\s*{_RAW_VALUE}"
    return F.zip_with(
        F.regexp_extract_all(tag, F.lit(pattern), 1),
        F.regexp_extract_all(tag, F.lit(pattern), 2),
        lambda n, v: F.struct(F.lower(n).alias("name"), unquote(v).alias("value")),
    )


def srcset_urls(value: Column) -> Column:
    """First token of each comma-separated candidate, inline data dropped."""
    parts = F.transform(F.split(value, ","), lambda c: F.element_at(F.split(F.trim(c), " "), 1))
    return F.filter(parts, lambda u: (u != "") & ~u.startswith("data:"))


def style_urls(style: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(style, F.lit(r"(?i)url\(['\"]?(.*?)['\"]?\)"), 1), lambda u: strip(u)
    )
    return F.filter(found, lambda u: (u != "") & ~u.startswith("data:"))


def script_bodies(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), 1)


def inline_urls(body: Column) -> Column:
    """Absolute URLs of known file types in a script body."""
    kinds = "|".join(rules.INLINE_URL_EXTENSIONS)
    pattern = rf"(?i)(https?://[^\s\"'<>\\]+?\.(?:{kinds}))(?=[\"'<>\s\\]|$)"
    return F.regexp_extract_all(body, F.lit(pattern), 1)


def inline_document_ids(body: Column) -> Column:
    kinds = "|".join(rules.INLINE_DOCUMENT_EXTENSIONS)
    ids = F.regexp_extract_all(
        body, F.lit(rf"(?i)[\"'](ugd/[a-zA-Z0-9_-]+\.(?:{kinds}))[\"']"), 1
    )
    return F.transform(ids, lambda i: F.concat(F.lit(rules.DOCUMENT_CDN_BASE), i))


def onclick_urls(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"['\"](https?://[^\s'\"]+|/[^\s'\"]+)['\"]"), 1)


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)


def json_urls(text: Column, base: Column) -> Column:
    """URLs of a JSON text: values of known keys and document ids, at any depth.

    Every string value sits next to its key in the text whatever the nesting, so
    one pass over the key/value pairs reaches all levels.  Text that is not valid
    JSON yields nothing.
    """
    # possessive loops: the Java matcher runs them without recursion on long strings
    quoted = r"\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\""
    pair = quoted + r"\s*:\s*" + quoted
    keys = F.regexp_extract_all(text, F.lit(pair), 1)
    values = F.regexp_extract_all(text, F.lit(pair), 2)
    decoded = F.zip_with(
        keys,
        values,
        lambda k, v: F.struct(
            F.lower(k).alias("k"),
            strip(
                F.when(
                    v.contains("\\"),
                    F.get_json_object(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "$.v"),
                ).otherwise(v)
            ).alias("v"),
        ),
    )

    def found(p: Column) -> Column:
        v = p["v"]
        stripped = F.regexp_replace(F.regexp_replace(v, r"^wix:document://v1/", ""), r"^/+", "")
        document = F.when(
            (v.contains("wix:document") | v.startswith("ugd/") | v.contains("/ugd/"))
            & stripped.startswith("ugd/"),
            F.concat(F.lit(rules.DOCUMENT_CDN_BASE), stripped),
        )
        by_key = F.when(
            p["k"].isin(rules.JSON_URL_KEYS),
            F.when(v.rlike(r"^https?://"), v)
            .when(v.startswith("ugd/"), F.concat(F.lit(rules.DOCUMENT_CDN_BASE), v))
            .when(
                urls.ends_with_any(v, rules.JSON_RELATIVE_EXTENSIONS), urls.resolve_relative(base, v)
            ),
        )
        keep = (v != "") & ~v.startswith("data:")
        return F.when(keep, F.array(document, by_key))

    hits = F.flatten(F.filter(F.transform(decoded, found), lambda a: a.isNotNull()))
    valid = text.rlike(r"[{\[]") & F.try_parse_json(text).isNotNull()
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.when(valid, hits).otherwise(none), lambda u: u.isNotNull()))
