"""File names, types, categories, gates and display text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import urls
from siftloom.functions.text import strip

UNSAFE = r"[\\/:*?\"<>|\x00-\x1f]"
_ENDS = r"(?U)^[\s._]+|[\s._]+$"


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Small fixed table as a map literal: a join without a join."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def dotted(extension: Column) -> Column:
    """Lower-case extension with one leading dot; '' for none; query and fragment cut."""
    raw = F.lower(F.trim(F.regexp_extract(F.coalesce(extension, F.lit("")), r"^([^?#]*)", 1)))
    return F.when((raw == "") | raw.startswith("."), raw).otherwise(F.concat(F.lit("."), raw))


def stem_of(name: Column) -> Column:
    """Name without its suffix."""
    return urls.let(
        name, lambda n: F.substring(n, F.lit(1), F.length(n) - F.length(urls.extension_of(n)))
    )


# --- names -------------------------------------------------------------------


def sanitize_filename(name: Column, max_length: int = 150) -> Column:
    """Collector form: separators to '_', ends trimmed, extension lower-cased."""

    def cut(stem: Column) -> Column:
        short = F.regexp_replace(F.substring(stem, 1, max_length), r"_+$", "")
        return F.when(stem == "", "unnamed").when(F.length(stem) > max_length, short).otherwise(stem)

    def clean(n: Column) -> Column:
        joined = F.regexp_replace(F.regexp_replace(stem_of(n), UNSAFE, "_"), r"(?U)[\s\-_]+", "_")
        ext = F.regexp_replace(urls.extension_of(n), UNSAFE, "")
        suffix = urls.let(
            F.lower(F.regexp_replace(ext, r"^[ ._]+|[ ._]+$", "")),
            lambda e: F.when(e == "", "").otherwise(F.concat(F.lit("."), e)),
        )
        return F.concat(urls.let(F.regexp_replace(joined, r"^[ ._]+|[ ._]+$", ""), cut), suffix)

    return urls.let(name, clean)


def sanitize_catalog_name(name: Column, max_length: int = 200) -> Column:
    """Catalog form: no '..', blanks to '_', unsafe runs to '_', ends trimmed."""
    # one pass: blanks and unsafe characters to '_', runs of them and of separators to one '_';
    # blanks at the ends become separators, which are trimmed
    joined = rf"(?U)[\s_{UNSAFE[1:-1]}-]{{2,}}|[\s{UNSAFE[1:-1]}]"

    def clean(n: Column) -> Column:
        text = F.when(F.contains(n, F.lit("..")), F.regexp_replace(n, r"\.\.+", ".")).otherwise(n)
        text = F.btrim(F.regexp_replace(text, joined, "_"), F.lit("._-"))
        return urls.let(text, lambda t: F.when(t == "", "file").otherwise(F.substring(t, 1, max_length)))

    return urls.let(name, clean)


def canonical_filename(original: Column, file_id: Column, extension: Column) -> Column:
    """{safe base}-{file id}{safe extension}."""

    def build(x: Column) -> Column:
        base = F.substring(x["name"], F.lit(1), F.length(x["name"]) - F.length(x["suffix"]))
        ext = F.when(F.coalesce(x["ext"], F.lit("")) != "", x["ext"]).otherwise(x["suffix"])
        bare = F.regexp_replace(F.regexp_replace(ext, r"\.\.+", "."), r"^\.", "")
        safe = F.concat(F.lit("."), F.regexp_replace(bare, UNSAFE + "+", ""))
        suffix = F.when(ext.rlike(r"^\.[A-Za-z0-9]+$") | (ext == ""), ext).otherwise(safe)
        return F.concat(sanitize_catalog_name(base), F.lit("-"), x["id"], suffix)

    suffix = F.regexp_extract(original, r"(?s)^.+(\.[^.]*)$", 1)
    return urls.let(
        F.struct(original.alias("name"), suffix.alias("suffix"), extension.alias("ext"), file_id.alias("id")),
        build,
    )


def is_generic_title(title: Column) -> Column:
    return urls.let(
        strip(F.coalesce(title, F.lit(""))),
        lambda t: (F.length(t) < 3) | F.lower(t).rlike(urls.alternation(rules.GENERIC_TITLES)),
    )


def display_name(
    embedded: Column, preferred: Column, url_name: Column, extension: Column
) -> Column:
    """Embedded title, else page or anchor name, else the URL name."""
    ext = F.coalesce(extension, F.lit(""))

    def named(title: Column) -> Column:
        return urls.let(
            sanitize_filename(title),
            lambda safe: F.when(safe != "unnamed", F.concat(stem_of(safe), ext)).otherwise(url_name),
        )

    return (
        F.when(embedded.isNotNull() & ~is_generic_title(embedded), named(embedded))
        .when(preferred.isNotNull() & ~is_generic_title(preferred), named(preferred))
        .otherwise(url_name)
    )


def record_name(title: Column, digest: Column) -> Column:
    """Name of a structured record: title (80 characters) and 8 digest characters."""
    named = F.when(F.coalesce(title, F.lit("")) == "", "web_content").otherwise(title)
    clean = F.substring(sanitize_filename(named), 1, 80)
    clean = F.when(clean == "", "web_content").otherwise(clean)
    return F.concat(clean, F.lit("_"), F.substring(digest, 1, 8), F.lit(".json"))


def format_file_id(number: Column) -> Column:
    return F.format_string("RAW-%09d", number)


def parse_file_id(file_id: Column) -> Column:
    return F.regexp_extract(file_id, r"^RAW-([0-9]+)$", 1).try_cast("long")


def format_run_id(day: Column, number: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.format_string("_run_%06d", number))


# --- categories and types ----------------------------------------------------


def _has(text: Column, parts: Sequence[str]) -> Column:
    return text.rlike(urls.alternation(parts))


def _worker_category(mime: Column, ext: Column) -> Column:
    m = F.trim(F.regexp_extract(F.lower(F.coalesce(mime, F.lit(""))), r"^([^;]*)", 1))
    by_mime = (
        F.when(m == "application/pdf", "pdf/digital")
        .when(m.startswith("audio/"), "audio")
        .when(m.startswith("video/"), "video")
        .when(m.startswith("image/"), "images")
        .when(m.startswith("text/vtt") | m.contains("subrip"), "subtitles")
        .when(m.startswith("text/"), "text")
        .when(_has(m, ["epub", "mobipocket", "fictionbook", "djvu"]), "ebooks")
        .when(_has(m, ["wordprocessingml", "msword", "opendocument.text", "rtf"]), "documents")
        .when(_has(m, ["spreadsheet", "excel"]), "spreadsheets")
        .when(_has(m, ["presentation", "powerpoint"]), "presentations")
        .when(_has(m, ["zip", "rar", "tar", "compressed", "gzip", "7z"]), "archives")
        .when(_has(m, ["json", "xml", "parquet", "feather"]), "data")
    )
    is_pdf = F.coalesce(mime == "application/pdf", F.lit(False)) | (ext == ".pdf")
    return F.when(is_pdf, "pdf/digital").otherwise(
        F.coalesce(lookup(rules.EXTENSION_CATEGORIES, ext), by_mime, F.lit("files"))
    )


def _api_category(mime: Column, ext: Column) -> Column:
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((ext == ".pdf") | F.coalesce(mime == "application/pdf", F.lit(False)), "pdf")
        .when(m.startswith("audio/"), "audio")
        .when(m.startswith("video/"), "video")
        .when(m.startswith("image/"), "images")
        .when(m.startswith("text/"), "text")
        .when(_has(m, ["zip", "rar", "compressed"]), "archives")
        .otherwise(F.coalesce(lookup(rules.EXTENSION_CATEGORIES, ext), F.lit("other")))
    )


def _browser_category(mime: Column, name: Column, key: Column) -> Column:
    key = F.coalesce(key, F.lit(""))
    parts = F.split(key, "/")
    count = F.size(parts)
    inner = F.array_join(F.slice(parts, 5, F.greatest(count - 5, F.lit(0))), "/")
    parent = F.try_element_at(parts, F.lit(-2))
    by_path = F.when(
        count >= 6,
        F.when(inner.isin("pdf/native/decoded", "pdf/native/encoded"), "pdf/digital").when(
            ~inner.isin("", "00_raw"), inner
        ),
    ).when((count >= 2) & ~parent.isin("", "00_raw"), parent)
    cut = F.regexp_extract(F.coalesce(name, F.lit("")), r"^([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(cut, r"([^.]*)$", 1))
    m = F.lower(F.coalesce(mime, F.lit("")))
    kinds = rules.BROWSER_CATEGORY_EXTENSIONS
    by_name = (
        F.when((ext == "pdf") | (m == "application/pdf"), "pdf/digital")
        .when(ext.isin(kinds["ebooks"]), "ebooks")
        .when(ext.isin(kinds["documents"]) | m.startswith("text/"), "documents")
        .when(ext.isin(kinds["audio"]) | m.startswith("audio/"), "audio")
        .when(ext.isin(kinds["video"]) | m.startswith("video/"), "video")
        .when(ext.isin(kinds["images"]) | m.startswith("image/"), "images")
        .when(ext.isin(kinds["data"]), "data")
        .when(ext.isin(kinds["archives"]) | _has(m, ["compressed", "zip"]), "archives")
        .otherwise("other")
    )
    return F.coalesce(by_path, by_name)


def categorize_file(
    mime: Column, extension: Column, policy: str = "worker",
    name: Column | None = None, key: Column | None = None,
) -> Column:
    """Storage category under one of the three rule orders (worker, api, browser)."""
    if policy == "worker":
        return _worker_category(mime, dotted(extension))
    if policy == "api":
        return _api_category(mime, dotted(extension))
    if policy == "browser":
        blank = F.lit("")
        return _browser_category(mime, blank if name is None else name, blank if key is None else key)
    raise ValueError(f"unknown category policy: {policy}")


def sniff_mime(content: Column) -> Column:
    """Type by leading bytes; zip containers are told apart by their first member."""
    head = F.hex(F.substring(content, 1, 64))
    kind = F.when(head.rlike("^504B0304.*6D696D65747970656170706C69636174696F6E2F657075622B7A6970"),
                  "application/epub+zip")
    for signature, offset, name in rules.MAGIC_SIGNATURES:
        start = 2 * offset + 1
        kind = kind.when(F.substring(head, start, len(signature)) == signature, name)
    return kind


def resolve_mime(content: Column, declared: Column, extension: Column) -> Column:
    """Signature, else declared type, else extension guess, else octet-stream."""
    said = F.lower(F.trim(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^([^;]*)", 1)))
    usable = F.when((said != "") & ~said.isin(rules.GENERIC_BINARY_MIMES), said)
    by_ext = {}
    for mime, ext in rules.MIME_EXTENSIONS.items():
        by_ext.setdefault(ext, mime)
    return F.coalesce(
        sniff_mime(content), usable, lookup(by_ext, dotted(extension)), declared,
        F.lit("application/octet-stream"),
    )


def served_mime(name: Column, mime: Column) -> Column:
    ext = F.lower(urls.extension_of(name))
    given = F.when((mime != "") & (mime != "application/octet-stream"), mime)
    return F.coalesce(given, lookup(rules.SERVED_MIME_TYPES, ext), F.lit("application/octet-stream"))


def disk_mime(extension: Column) -> Column:
    return F.coalesce(
        lookup(rules.DISK_MIME_TYPES, F.lower(extension)), F.lit("application/octet-stream")
    )


def infer_extension(name: Column, mime: Column) -> Column:
    """struct(extension, file_name) after the type fills in a missing or script suffix."""
    ext = F.nullif(F.lower(urls.extension_of(name)), F.lit(""))
    known = lookup(rules.MIME_EXTENSIONS, mime)
    replaced = known.isNotNull() & (ext.isNull() | ext.isin(rules.DYNAMIC_PAGE_EXTENSIONS))
    fixed = F.when(
        replaced & ~F.endswith(F.lower(name), known), F.concat(stem_of(name), known)
    ).otherwise(name)
    return F.struct(
        F.when(replaced, known).otherwise(ext).alias("extension"), fixed.alias("file_name")
    )


# --- gates -------------------------------------------------------------------


def reject_reason(
    mime: Column, extension: Column,
    allowed_extensions: Sequence[str] = (), allowed_mimes: Sequence[str] = (),
) -> Column:
    """Why a download is not admitted, or NULL when it is."""
    exts = [e.lower() if e.startswith(".") else "." + e.lower() for e in allowed_extensions if e.strip()]
    mimes = [m.strip().lower() for m in allowed_mimes if m and m.strip()]
    m, e = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(extension, F.lit("")))
    reason = F.when(F.coalesce(mime, F.lit("")).contains("text/html") & F.lit(".html" not in exts), "unexpected_html")
    if exts:
        same = [F.lit(".pdf" in exts) & m.contains("application/pdf"),
                F.lit(".epub" in exts) & m.contains("epub"),
                F.lit(".docx" in exts) & m.contains("wordprocessingml")]
        reason = reason.when(~e.isin(exts) & ~urls.any_of(same), "extension_not_allowed")
    if mimes:
        kind = F.trim(F.regexp_extract(m, r"^([^;]*)", 1))
        ok = [kind == a for a in mimes] + [kind.startswith(a[:-1]) for a in mimes if a.endswith("/*")]
        reason = reason.when(~urls.any_of(ok), "mime_not_allowed")
    return reason.otherwise(None)


def size_error(size: Column, max_bytes: int = rules.MAX_FILE_BYTES) -> Column:
    return F.when(size > max_bytes, "FILE_TOO_LARGE").when(size == 0, "INVALID_CONTENT")


def is_retryable(message: Column) -> Column:
    return message.rlike(urls.alternation(rules.RETRYABLE_MARKERS))


def error_code(kind: Column) -> Column:
    """Catalog code for the kind of failure a download reports."""
    return (
        F.when(kind == "too_large", "FILE_TOO_LARGE")
        .when(kind == "storage", "R2_UPLOAD_ERROR")
        .otherwise("NETWORK_ERROR")
    )


# --- JSON accessors ----------------------------------------------------------


def metadata_accessors(metadata: Column) -> Column:
    """struct(language_code, language_name, quality_score, topic, topic_confidence)."""
    known = (
        "language struct<language:string,language_name:string>, quality struct<score:string>, "
        "kurdish_category struct<category:string,confidence:string>"
    )

    def read(m: Column) -> Column:
        lang, topic = m["language"], m["kurdish_category"]
        both = (F.coalesce(lang["language"], F.lit("")) != "") & (F.coalesce(lang["language_name"], F.lit("")) != "")
        named = ~F.coalesce(topic["category"], F.lit("")).isin("", "unknown", "general")
        score = m["quality"]["score"].try_cast("double")
        confidence = F.coalesce(topic["confidence"].try_cast("double"), F.lit(0.0))
        return F.struct(
            F.when(both, lang["language"]).alias("language_code"),
            F.when(both, lang["language_name"]).alias("language_name"),
            F.when(score != 0, score).alias("quality_score"),
            F.when(named, topic["category"]).alias("topic"),
            F.when(named, confidence).alias("topic_confidence"),
        )

    return urls.let(F.from_json(metadata, known), read)


def article_view(record: Column, file_name: Column | None = None) -> Column:
    """struct(title, url, body, paragraphs, word_count, language, quality_score)."""

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(record, p), F.lit("")) for p in paths])

    body = first("$.body_text", "$.text", "$.content", "$.extracted_text")
    listed = F.from_json(F.get_json_object(record, "$.paragraphs"), "array<string>")
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    given = F.nullif(first("$.word_count").try_cast("int"), F.lit(0))
    names = [first("$.title", "$.headline")] + ([file_name] if file_name is not None else [])
    return F.struct(
        F.coalesce(*names, F.lit("Scraped Document")).alias("title"),
        first("$.url", "$.sourceUrl", "$.source_url").alias("url"),
        body.alias("body"),
        F.coalesce(
            listed,
            F.when(strip(body) != "", F.split(body, r"(?U)\n\s*\n")),
            F.array().cast("array<string>"),
        ).alias("paragraphs"),
        F.coalesce(given, words, F.lit(0)).alias("word_count"),
        first("$.language.language", "$.lang", "$.language").alias("language"),
        first("$.quality.overall_score", "$.qualityScore").try_cast("double").alias("quality_score"),
    )


def search_lines(df: DataFrame, key: str, column: str, term: str) -> DataFrame:
    """Lines of a text column that contain ``term``, whatever the case, with their number."""
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    needle = term.lower()
    return lines.where(F.lower("line").contains(needle)) if term.strip() else lines


# --- display text ------------------------------------------------------------


def duration_ms(started: Column, completed: Column, now: Column | None = None) -> Column:
    end = completed if now is None else F.coalesce(completed, now)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor((micros(end) - micros(started)) / 1000))


def duration_text(ms: Column) -> Column:
    whole = lambda unit: F.floor(ms / unit).cast("long").cast("string")
    rest = lambda big, unit: F.floor((ms % big) / unit).cast("long").cast("string")
    return (
        F.when(ms.isNull(), "—")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(whole(1000), F.lit("s")))
        .when(ms < 3600000, F.concat(whole(60000), F.lit("m "), rest(60000, 1000), F.lit("s")))
        .otherwise(F.concat(whole(3600000), F.lit("h "), rest(3600000, 60000), F.lit("m")))
    )


def byte_text(size: Column) -> Column:
    """Base 1024, one decimal, no trailing zero."""
    text = F.when(size.isNull(), "—").when(size == 0, "0 B")
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = F.format_string("%.1f", F.round(size / F.lit(float(1024**power)), 1))
        text = text.when(
            size >= 1024**power,
            F.concat(F.regexp_replace(scaled, r"\.0$", ""), F.lit(" " + unit)),
        )
    return text.otherwise("0 B")


# --- sources and presets -----------------------------------------------------


def source_metadata(slug: Column, name: Column, base_url: Column) -> Column:
    """struct(name, slug, base_url, description) with mangled values repaired."""
    clean = F.lower(F.trim(slug))
    given_url = F.coalesce(base_url, F.lit(""))
    is_channel = clean.rlike(r"^(?:telegram-|tg-)") | given_url.contains("t.me/")
    channel = F.regexp_replace(F.regexp_replace(clean, r"^(?:telegram-|tg-)", ""), "@", "")
    domain = F.regexp_replace(clean, r"^www[-_]", "www.")
    domain = F.regexp_replace(domain, r"[-_]gov[-_](krd|iq)$", ".gov.$1")
    # each top-level name is tried once, in order, on what the one before left
    for tld in rules.SLUG_TLDS:
        domain = F.regexp_replace(domain, rf"[-_]{tld}$", f".{tld}")
    domain = F.regexp_replace(domain, r"^diyako-yageyziman", "diyako.yageyziman")
    given = F.coalesce(name, F.lit(""))
    mangled = (
        (given == "")
        | given.rlike("WWW | COM| ORG| NET| KRD|-")
        | (given == F.upper(given))
        | (F.lower(given) == F.lower(slug))
    )
    core = F.regexp_replace(
        F.regexp_replace(domain, r"^www\.", ""), rf"\.(?:{'|'.join(rules.SLUG_TLDS)}|gov)$", ""
    )
    words = F.transform(
        F.filter(F.split(core, r"[-_.]"), lambda w: w != ""),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))),
    )
    known = F.when(F.lit(False), "")
    for kind, parts, label in rules.KNOWN_SOURCE_NAMES:
        test = F.lit(True)
        for part in parts:
            test = test & (clean == part if kind == "equals" else clean.contains(part))
        known = known.when(test, label)
    fixed_name = F.when(mangled, F.coalesce(known, F.array_join(words, " "))).otherwise(given)
    bad_url = (
        (given_url == "")
        | given_url.rlike(r"-com\.com|-org\.com|-krd\.com$|https://www-|https://diyako-yageyziman-")
    )
    fixed_url = (
        F.when(bad_url, F.concat(F.lit("https://"), domain))
        .when(~given_url.rlike("^https?://"), F.concat(F.lit("https://"), given_url))
        .otherwise(given_url)
    )

    def pick(for_channel: Column, otherwise: Column, alias: str) -> Column:
        return F.when(is_channel, for_channel).otherwise(otherwise).alias(alias)

    return F.struct(
        pick(
            F.concat(F.lit("Telegram: @"), channel),
            F.when(fixed_name == "", clean).otherwise(fixed_name),
            "name",
        ),
        pick(F.concat(F.lit("telegram-"), channel), clean, "slug"),
        pick(F.concat(F.lit("https://t.me/"), channel), fixed_url, "base_url"),
        pick(
            F.concat(F.lit("Telegram Channel Collector for @"), channel),
            F.concat(F.lit("Auto-created source for "), domain),
            "description",
        ),
    )


def expand_presets(chosen: Column, presets: Mapping[str, Sequence[str]] = rules.EXTENSION_PRESETS) -> Column:
    """Distinct extensions of the chosen presets, in preset order; 'all' lifts the list."""
    parts = [
        F.when(F.array_contains(chosen, name), F.array(*[F.lit(e) for e in exts])).otherwise(
            F.array().cast("array<string>")
        )
        for name, exts in presets.items()
    ]
    none = F.array().cast("array<string>")
    return F.when(F.array_contains(chosen, "all"), none).otherwise(F.array_distinct(F.concat(*parts)))


def channel_list(text: Column) -> Column:
    parts = F.transform(
        F.split(text, r"[\n,]+"), lambda c: F.regexp_replace(F.trim(c), "^@", "")
    )
    return F.filter(parts, lambda c: c != "")


# --- storage keys ------------------------------------------------------------


def storage_key_parts(key: Column) -> Column:
    """struct(source_slug, run_key) from the four folder layouts, else from any run-like part."""
    parts = F.filter(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    count = F.size(parts)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    raw_zone = F.coalesce(part(1).isin("00_raw", "raw"), F.lit(False))
    zones = ["web", "telegram", "media", "data"]
    zoned_raw = raw_zone & (count >= 3) & F.coalesce(F.lower(part(2)).isin(zones), F.lit(False))
    zoned = ~raw_zone & F.coalesce(F.lower(part(1)).isin(zones), F.lit(False))

    # position of the source folder; the run folder follows it
    at = F.when(zoned_raw, 3).when(raw_zone | zoned, 2).otherwise(1)
    source = F.try_element_at(parts, at)
    follower = F.try_element_at(parts, at + 1)
    direct = F.when(count >= at + 2, follower).when(
        (count == at + 1) & ~follower.contains("."), follower
    )
    run_like = (
        r"_run_|^run_|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}|^202[0-9]{5}|^202[0-9]-[0-9]{2}-[0-9]{2}"
    )
    looks = F.try_element_at(F.filter(parts, lambda p: p.rlike(run_like)), F.lit(1))
    return F.struct(
        F.coalesce(source, F.lit("recovered-source")).alias("source_slug"),
        F.coalesce(direct, looks).alias("run_key"),
    )


def clean_key(key: Column) -> Column:
    return F.regexp_replace(key, r"^[/\\]+", "")


_TEXT = "=" * 33


def packed_hash(value: Column) -> Column:
    """A hash as bytes for shuffles: 64 lower-case hex digits as 32 bytes, other text as more than that."""
    return F.when(value.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(value)).otherwise(F.encode(F.concat(F.lit(_TEXT), value), "UTF-8"))


def unpacked_hash(packed: Column) -> Column:
    return F.when(F.octet_length(packed) == 32, F.lower(F.hex(packed))).otherwise(
        F.substring(F.decode(packed, "UTF-8"), len(_TEXT) + 1, 1 << 30))
