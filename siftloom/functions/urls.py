"""URL column functions.  All are built-in expressions; none needs a Python worker.

``parse_url`` raises under ANSI mode and ``try_parse_url`` rejects URLs that hold
spaces or non-ASCII hosts, so pieces are taken with regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftloom import rules

SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def alternation(values: Sequence[str]) -> str:
    return "|".join(re.escape(v) for v in values)


def literal_array(values: Sequence[str]) -> Column:
    """Constant array of strings, built in one step."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Without this, nested functions that name their argument several times would
    repeat whole sub-trees.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(value: Column) -> Column:
    """NULL for an empty string."""
    return let(value, lambda v: F.when(v != "", v))


def ends_with_any(column: Column, suffixes: Sequence[str]) -> Column:
    """One pass over the string instead of one comparison per suffix."""
    return column.rlike(f"(?:{alternation(suffixes)})$")


# --- pieces ------------------------------------------------------------------


def clean(url: Column) -> Column:
    """Trim, and drop the line breaks and tabs that URL parsers ignore."""
    return F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query(url: Column) -> Column:
    return F.substring(F.regexp_extract(url, SPLIT, 4), 2, 1 << 30)


def host(url: Column) -> Column:
    """Lower-case host without user-info, port and brackets; '' when absent."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(
        F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_replace(bare, r":[^:]*$", "")
        )
    )


def port(url: Column) -> Column:
    """Port digits as text, '' when absent."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.regexp_extract(bare, r"(?:^|[^:\]]|\])(?::([^:\]]*))?$", 1)


# --- percent coding ----------------------------------------------------------


def percent_decode(text: Column, plus_as_space: bool = False) -> Column:
    """Decode ``%XX`` as UTF-8; stray percent signs stay as they are."""

    def decode(t: Column) -> Column:
        safe = F.regexp_replace(t, r"%(?![0-9A-Fa-f]{2})", "%25")
        if not plus_as_space:
            safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
        return F.when(t.rlike(r"[%+]"), F.coalesce(F.try_url_decode(safe), t)).otherwise(t)

    return let(text, decode)


def _encode(text: Column, keep: str, space: str) -> Column:
    """Form-encode, then restore the kept characters; an encoded percent sign comes last."""
    pairs = [("+", space), ("*", "%2A")]
    pairs += [(f"%{ord(c):02X}", c) for c in keep if c != "%"]
    pairs += [("%25", "%")] if "%" in keep else []
    found = literal_array([a for a, _ in pairs])
    put = literal_array([b for _, b in pairs])
    steps = F.arrays_zip(found.alias("a"), put.alias("b"))
    return F.aggregate(steps, F.url_encode(text), lambda acc, x: F.replace(acc, x["a"], x["b"]))


def percent_encode_path(text: Column) -> Column:
    """Encode a decoded path, keeping the characters a path may hold."""
    plain = r"^[A-Za-z0-9/:~%+=&;$@,\-_.]*$"
    return let(
        text, lambda t: F.when(t.rlike(plain), t).otherwise(_encode(t, "/:~%+=&;$@,", "%20"))
    )


def form_encode(text: Column) -> Column:
    return let(
        text,
        lambda t: F.when(t.rlike(r"^[A-Za-z0-9_.~\-]*$"), t).otherwise(_encode(t, "~", "+")),
    )


# --- resolution and normal form ---------------------------------------------


def _drop_dot_segments(segments: Column) -> Column:
    empty = F.slice(segments, 1, 0)
    walked = F.aggregate(
        segments,
        empty,
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.element_at(segments, -1)
    return F.when(tail.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)


def resolve_relative(base: Column, ref: Column) -> Column:
    """Absolute URL of ``ref`` seen from ``base``.

    Absolute and plain root-relative targets, nearly all of a page's links, are
    answered by the first branches without splitting a path.
    """
    return let(F.struct(base.alias("base"), ref.alias("ref")), lambda x: _resolve(x["base"], x["ref"]))


def _resolve(base: Column, ref: Column) -> Column:
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, SPLIT, 1), F.lit(":"), ref))
        .when(ref.rlike(r"^/(?!.*?\.)|^/(?!.*?/\.\.?(?:[/?#]|$))(?!\.\.?(?:[/?#]|$))"), F.concat(origin, ref))
        .when(ref.rlike("^[?#]"), F.concat(origin, path(base), _query_and_fragment(base, ref)))
        .otherwise(F.concat(origin, _join_paths(path(base), path(ref)), rest))
    )


def _query_and_fragment(base: Column, ref: Column) -> Column:
    own = F.regexp_extract(ref, SPLIT, 4)
    return F.concat(
        F.when(own == "", F.regexp_extract(base, SPLIT, 4)).otherwise(own),
        F.regexp_extract(ref, SPLIT, 5),
    )


def _join_paths(base_path: Column, ref_path: Column) -> Column:
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    merged = F.when(ref_path.startswith("/"), ref_path).otherwise(
        # a relative join also drops empty segments inside the path
        F.regexp_replace(
            F.concat(F.when(folder == "", "/").otherwise(folder), ref_path), r"/{2,}", "/"
        )
    )
    target = let(F.split(merged, "/"), lambda s: F.array_join(_drop_dot_segments(s), "/"))
    return let(target, lambda t: F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)))


def _clean_query(raw: Column, tracking: Sequence[str]) -> Column:
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            percent_decode(F.regexp_extract(p, r"^([^=]*)", 1), True).alias("k"),
            percent_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1), True).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.array_contains(literal_array(tracking), F.lower(p["k"]))))
    text = F.array_join(
        F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))),
        "&",
    )
    return F.when(raw == "", "").otherwise(text)


def normalize_url(
    url: Column, base: Column | None = None, tracking: Sequence[str] = rules.TRACKING_PARAMS
) -> Column:
    """The one identity of a URL; NULL when malformed or not http(s).

    Scheme and host are lower-cased; default port, fragment, ``;params``, user-info
    and tracking parameters go; the rest of the query is sorted.
    """
    if base is None:
        return let(clean(url), lambda text: _normal(text, tracking))

    def absolute(text: Column) -> Column:
        return F.when(text == "", F.lit(None)).otherwise(resolve_relative(base, text))

    return let(let(clean(url), absolute), lambda text: _normal(text, tracking))


#: URLs that are their own normal form: no port, query, fragment or end slash
_NORMAL = r"^https?://[a-z0-9.\-]+(?:/|(?:/[A-Za-z0-9._~\-]+)+)$"


def _normal(text: Column, tracking: Sequence[str]) -> Column:
    parts = F.struct(
        scheme(text).alias("kind"), host(text).alias("name"), port(text).alias("digits"),
        F.regexp_replace(path(text), r";[^/]*$", "").alias("path"), query(text).alias("query"),
    )
    return F.when(text.rlike(_NORMAL), text).otherwise(let(parts, lambda p: _assemble(p, tracking)))


def _assemble(p: Column, tracking: Sequence[str]) -> Column:
    number = p["digits"].try_cast("int")
    default = F.when(p["kind"] == "http", 80).otherwise(443)
    netloc = F.when(
        number.isNotNull() & (number != 0) & (number != default),
        F.concat(p["name"], F.lit(":"), number.cast("string")),
    ).otherwise(p["name"])
    trimmed = F.regexp_replace(percent_encode_path(percent_decode(p["path"])), r"/+$", "")
    route = let(trimmed, lambda t: F.when(t == "", "/").otherwise(t))
    args = let(
        _clean_query(p["query"], tracking),
        lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)),
    )
    valid = (
        p["kind"].isin("http", "https")
        & (p["name"] != "")
        & ((p["digits"] == "") | (p["digits"].rlike(r"^[0-9]{1,5}$") & (number <= 65535)))
    )
    return F.when(valid, F.concat(p["kind"], F.lit("://"), netloc, route, args))


def split_host(url: Column) -> Column:
    """struct(domain, subdomain, route): last two labels, the rest, path or '/'."""
    return let(F.struct(host(url).alias("h"), path(url).alias("p")), _host_parts)


def _host_parts(x: Column) -> Column:
    labels = F.split(x["h"], r"\.")
    count = F.size(labels)
    return F.struct(
        F.when(count >= 2, F.substring_index(x["h"], ".", -2)).otherwise(x["h"]).alias("domain"),
        F.when(
            count > 2, F.array_join(F.slice(labels, 1, F.greatest(count - 2, F.lit(0))), ".")
        ).otherwise("").alias("subdomain"),
        F.when(x["p"] == "", "/").otherwise(x["p"]).alias("route"),
    )


# --- domain rules ------------------------------------------------------------


def same_domain_or_subdomain(hostname: Column, domain: Column) -> Column:
    hostname, domain = F.lower(hostname), F.lower(domain)
    return (hostname == domain) | F.endswith(hostname, F.concat(F.lit("."), domain))


def _bare(name: str) -> str:
    name = name.lower()
    return name[4:] if name.startswith("www.") else name


def without_www(hostname: Column) -> Column:
    return F.regexp_replace(hostname, r"^www\.", "")


def allowed_domain(url: Column, domains: Sequence[str]) -> Column:
    """Host matches a listed domain by suffix, in either direction; no list allows all."""
    if not domains:
        return F.lit(True)
    wanted = [_bare(d) for d in domains]
    # the parents of a listed domain are allowed too
    above = {d.split(".", i)[-1] for d in wanted for i in range(1, d.count(".") + 1)}
    return let(
        without_www(host(url)),
        lambda name: (name != "")
        & (name.rlike(f"(?:^|\\.)(?:{alternation(wanted)})$") | name.isin(sorted(above))),
    )


def allowed_resource_domain(
    url: Column, domains: Sequence[str], cdns: Sequence[str] = rules.TRUSTED_CDN_DOMAINS
) -> Column:
    trusted = host(url).rlike(f"(?:^|\\.)(?:{alternation(cdns)})$")
    return allowed_domain(url, domains) | trusted


def host_suffixes(hostname: Column) -> Column:
    """Every dot-aligned suffix of a host, itself included."""
    labels = F.split(hostname, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: first and last address (exclusive) of the private and reserved IPv4 blocks
_PRIVATE_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]


def ipv4_number(hostname: Column) -> Column:
    """32-bit number of an IPv4 literal, NULL for anything else."""
    parts = F.split(hostname, r"\.")
    number = F.aggregate(
        F.transform(parts, lambda p: p.try_cast("long")),
        F.lit(0).cast("long"),
        lambda acc, p: acc * 256 + p,
    )
    return F.when(hostname.rlike(_IPV4), number)


def private_host(url: Column, blocked: Sequence[str] = rules.BLOCKED_HOSTS) -> Column:
    """Literal check against internal targets; names are never matched by prefix."""
    return let(host(url), lambda name: _private_name(name, blocked))


def _private_name(name: Column, blocked: Sequence[str]) -> Column:
    def in_blocks(number: Column) -> Column:
        ranges = []
        for start, bits in _PRIVATE_BLOCKS:
            first = reduce(lambda acc, o: acc * 256 + int(o), start.split("."), 0)
            ranges.append((number >= first) & (number < first + (1 << (32 - bits))))
        return any_of(ranges)

    v6 = name.contains(":") & name.rlike(
        r"^(?:::1?|(?:0{1,4}:){7}0{0,3}[01]|f[cd][0-9a-f]{0,2}:.*|fe[89ab][0-9a-f]?:.*"
        r"|2001:db8:.*|::ffff:(?:127|10|192\.168|169\.254)\..*)$"
    )
    literal = F.when(name.rlike(_IPV4), let(ipv4_number(name), in_blocks)).otherwise(F.lit(False))
    return (name == "") | name.isin(list(blocked)) | literal | v6


# --- pattern and file rules --------------------------------------------------


def matches_any(url: Column, patterns: Sequence[str]) -> Column:
    return any_of([url.rlike(p) for p in patterns])


def passes_patterns(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    keep = matches_any(url, include) if include else F.lit(True)
    return keep & ~matches_any(url, exclude) if exclude else keep


def is_downloadable_url(url: Column, extensions: Sequence[str] = ()) -> Column:
    """URL names a file by path suffix, query hint, path segment or hosting service."""
    custom = bool(extensions)
    dotted = [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions]
    targets = dotted or rules.DOWNLOADABLE_EXTENSIONS
    names = alternation([t.lstrip(".") for t in targets])
    parts = F.struct(
        url.alias("url"), F.lower(path(url)).alias("route"), F.lower(query(url)).alias("args")
    )

    def test(p: Column) -> Column:
        u, route, args = p["url"], p["route"], p["args"]
        by_query = args.rlike(rf"(?:\.|format=|type=|file=|ext=)(?:{names})")
        if not custom:
            by_query = by_query | args.rlike(r"export=download|dl=1|download=true")
        tests = [
            ends_with_any(route, targets),
            by_query,
            route.rlike(rf"/(?:{names})(?:/|$)"),
            u.rlike(r"usrfiles\.com|wixstatic\.com/docs")
            & (route.rlike(alternation(targets)) | args.rlike(alternation(targets))),
        ]
        if not custom or set(targets) & set(rules.DRIVE_EXTENSIONS):
            tests.append(
                u.rlike(r"(?:drive|docs)\.google\.com")
                & (args.contains("export=download") | route.rlike("/file/d/|/uc"))
            )
        return ~ends_with_any(route, rules.THEME_ASSET_EXTENSIONS) & any_of(tests)

    return let(parts, test)


def cloud_share_to_direct(url: Column) -> Column:
    file_id = F.regexp_extract(url, r"/file/d/([a-zA-Z0-9_-]+)", 1)
    on_drive = url.contains("drive.google.com") | url.contains("docs.google.com")
    on_dropbox = ~on_drive & url.contains("dropbox.com")
    return (
        F.when(
            on_drive & (file_id != ""),
            F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id),
        )
        .when(on_dropbox & url.contains("dl=0"), F.replace(url, F.lit("dl=0"), F.lit("dl=1")))
        .when(
            on_dropbox & ~url.contains("dl=1") & ~url.contains("?"),
            F.concat(url, F.lit("?dl=1")),
        )
        .otherwise(url)
    )


def is_navigational(href: Column) -> Column:
    """False for script, mail, phone, fragment and inline-data targets."""
    return (href != "") & ~href.rlike(r"^(?:javascript:|mailto:|tel:|#|data:)")


def expand_document_id(ref: Column, base: str = rules.DOCUMENT_CDN_BASE) -> Column:
    """Short ids of the document CDN become absolute URLs."""
    short = (ref.startswith("ugd/") | ref.contains("usrfiles.com")) & ~ref.startswith("http")
    return F.when(short, F.concat(F.lit(base), F.regexp_replace(ref, r"^/+", ""))).otherwise(ref)


def channel_target(text: Column) -> Column:
    """struct(is_channel, name) of ``@name`` and channel links."""
    raw = F.trim(text)
    linked = raw.rlike(r"t\.me/|telegram\.me/|telegram\.org/")
    full = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit("https://"), raw))
    parts = F.filter(F.split(path(full), "/"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    name = F.when(
        (first == "s") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(2))
    ).otherwise(first)
    is_channel = raw.startswith("@") | linked
    return F.struct(
        F.coalesce(is_channel, F.lit(False)).alias("is_channel"),
        F.when(raw.startswith("@"), F.substring(raw, 2, 1 << 30))
        .when(linked, F.coalesce(name, F.lit("telegram_channel")))
        .alias("name"),
    )


def is_video_host(url: Column) -> Column:
    netloc = F.lower(authority(url))
    return netloc.contains("youtube.com") | netloc.contains("youtu.be")


def basename(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^.*/", "")


def extension_of(name: Column) -> Column:
    """Suffix with its dot, '' when there is none; leading dots do not count."""
    return F.regexp_extract(basename(name), r"(?s)^\.*[^.].*?(\.[^.]*)$|^$", 1)


def filename_from_url(url: Column, disposition: Column | None = None) -> Column:
    """File name from the header if there is one, else from the URL."""
    name = basename(percent_decode(path(url)))
    ext = F.lower(extension_of(name))
    hint = F.trim(F.regexp_extract(query(url), r"(?i)(?:file|filename|name|dn|title)=([^&#]+)", 1))
    candidate = basename(percent_decode(hint))
    from_query = (
        ((ext == "") | ext.isin(rules.SCRIPT_PAGE_EXTENSIONS))
        & (hint != "")
        & (extension_of(candidate) != "")
    )
    from_url = F.when(from_query, candidate).when(name != "", name).otherwise("unknown")
    if disposition is None:
        return from_url
    coded = F.trim(F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*utf-8''([^;\n]+)", 1))
    plain = F.trim(
        F.regexp_extract(disposition, r"filename[^;=\n]*=(?:\"([^\";]+)\"|'([^';]+)'|([^;]+))", 1)
    )
    single = F.trim(F.regexp_extract(disposition, r"filename[^;=\n]*='([^';]+)'", 1))
    bare = F.trim(F.regexp_extract(disposition, r"filename[^;=\n*]*=([^\"';][^;]*)", 1))
    header = F.when(coded != "", coded).when(plain != "", plain).when(single != "", single).when(
        bare != "", bare
    )
    return F.coalesce(basename(percent_decode(header)), from_url)
