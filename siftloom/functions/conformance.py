"""Schema checks that keep every row and list what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions.urls import any_of

_URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://)?[^\s/?#].*$"

#: limits and defaults of a web collector (fixed values): name, minimum, maximum, default
WEB_NUMBERS = [
    ("maxDepth", 1, 20, 5), ("maxPages", 1, 100000, 10000), ("maxFiles", 1, 100000, 10000),
    ("requestDelayMs", 0, 60000, 1000), ("concurrency", 1, 32, 4),
    ("requestTimeoutSeconds", 5, 300, 30), ("maxRetries", 0, 10, 3),
]
WEB_LISTS = [
    "allowedDomains", "allowedUrlPatterns", "excludedUrlPatterns", "allowedExtensions",
    "allowedMimeTypes",
]
WEB_FLAGS = [("useBrowser", False), ("extractWebData", False), ("robotsEnabled", True)]

WEB_CONFIG = (
    "startUrls array<string>, "
    + ", ".join(f"{n} array<string>" for n in WEB_LISTS)
    + ", "
    + ", ".join(f"{n} bigint" for n, *_ in WEB_NUMBERS)
    + ", "
    + ", ".join(f"{n} boolean" for n, _ in WEB_FLAGS)
)
CHANNEL_CONFIG = (
    "channels array<string>, messageLimit bigint, sinceDate string, downloadMedia boolean, "
    "includeMediaTypes array<string>, allowedExtensions array<string>, saveMessageJson boolean"
)
MEDIA_CONFIG = (
    "mediaUrl string, startUrls array<string>, localPath string, audioChunkSeconds bigint, "
    "geminiModel string"
)


def violations(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that fail, in order."""
    names = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]
    return F.filter(F.array(*names), lambda v: v.isNotNull())


def _out_of(value: Column, low: int, high: int) -> Column:
    return (value < low) | (value > high)


def collector_config(kind: Column, configuration: Column) -> Column:
    """struct(config, violations): defaults filled in, checks by collector type.

    Types other than TELEGRAM and MEDIA use the web rules.
    """
    web = F.from_json(configuration, WEB_CONFIG)
    channel = F.from_json(configuration, CHANNEL_CONFIG)
    media = F.from_json(configuration, MEDIA_CONFIG)
    no_list = F.array().cast("array<string>")

    web_filled = F.struct(
        web["startUrls"].alias("startUrls"),
        *[F.coalesce(web[n], no_list).alias(n) for n in WEB_LISTS],
        *[F.coalesce(web[n], F.lit(d)).alias(n) for n, _, _, d in WEB_NUMBERS],
        *[F.coalesce(web[n], F.lit(d)).alias(n) for n, d in WEB_FLAGS],
    )
    web_bad = violations(
        ("startUrls:required", web["startUrls"].isNull() | (F.size(web["startUrls"]) < 1)),
        ("startUrls:url", F.exists(web["startUrls"], lambda u: ~u.rlike(_URL))),
        *[(f"{n}:range", _out_of(web[n], low, high)) for n, low, high, _ in WEB_NUMBERS],
    )
    channel_filled = F.struct(
        channel["channels"].alias("channels"),
        F.coalesce(channel["messageLimit"], F.lit(500)).alias("messageLimit"),
        channel["sinceDate"].alias("sinceDate"),
        F.coalesce(channel["downloadMedia"], F.lit(True)).alias("downloadMedia"),
        F.coalesce(channel["includeMediaTypes"], no_list).alias("includeMediaTypes"),
        F.coalesce(channel["allowedExtensions"], no_list).alias("allowedExtensions"),
        F.coalesce(channel["saveMessageJson"], F.lit(False)).alias("saveMessageJson"),
    )
    channel_bad = violations(
        ("channels:required", channel["channels"].isNull() | (F.size(channel["channels"]) < 1)),
        ("channels:blank", F.exists(channel["channels"], lambda c: c == "")),
        ("messageLimit:range", _out_of(channel["messageLimit"], 1, 100000)),
        ("sinceDate:datetime", channel["sinceDate"].isNotNull()
         & ~channel["sinceDate"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")),
        ("includeMediaTypes:value",
         F.exists(channel["includeMediaTypes"], lambda k: ~k.isin(rules.MEDIA_KINDS))),
    )
    media_filled = F.struct(
        media["mediaUrl"].alias("mediaUrl"), media["startUrls"].alias("startUrls"),
        media["localPath"].alias("localPath"),
        F.coalesce(media["audioChunkSeconds"], F.lit(30)).alias("audioChunkSeconds"),
        F.coalesce(media["geminiModel"], F.lit("gemini-2.0-flash")).alias("geminiModel"),
    )
    media_bad = violations(("audioChunkSeconds:range", _out_of(media["audioChunkSeconds"], 1, 300)))
    broken = F.try_parse_json(configuration).isNull()
    by_kind = lambda c, m, w: F.when(kind == "TELEGRAM", c).when(kind == "MEDIA", m).otherwise(w)
    return F.struct(
        by_kind(F.to_json(channel_filled), F.to_json(media_filled), F.to_json(web_filled)).alias("config"),
        F.when(broken, F.array(F.lit("configuration:json")))
        .otherwise(by_kind(channel_bad, media_bad, web_bad))
        .alias("violations"),
    )


def file_violations(name: Column, size: Column, status: Column) -> Column:
    return violations(
        ("fileName:required", name.isNull() | (F.length(name) < 1)),
        ("fileSize:negative", size < 0),
        ("status:value", status.isNull() | ~status.isin(rules.FILE_STATUSES)),
    )


def run_violations(status: Column, *counters: Column) -> Column:
    return violations(
        ("status:value", status.isNull() | ~status.isin(rules.REPORTED_RUN_STATUSES)),
        ("counters:negative", any_of([c < 0 for c in counters])),
    )


def error_violations(code: Column, message: Column) -> Column:
    return violations(
        ("errorCode:value", code.isNull() | ~code.isin(rules.ERROR_CODES)),
        ("message:required", message.isNull() | (F.length(message) < 1)),
    )


def source_conformance(sources: DataFrame) -> DataFrame:
    """Sources with a ``violations`` column; a slug used twice counts on every use.

    Slug counts are pre-aggregated, so no slug is gathered in one task.
    """
    slug, name, url = F.col("slug"), F.col("name"), F.col("base_url")
    repeated = (
        sources.groupBy("slug").count().where("count > 1").select("slug", F.lit(True).alias("_again"))
    )
    return sources.join(repeated, "slug", "left").withColumn(
        "violations",
        violations(
            ("name:length", name.isNull() | _out_of(F.length(name), 1, 200)),
            ("slug:length", slug.isNull() | _out_of(F.length(slug), 1, 100)),
            ("slug:format", ~slug.rlike(r"^[a-z0-9\-_]+$")),
            ("slug:duplicate", F.col("_again")),
            ("baseUrl:url", url.isNull() | ~url.rlike(_URL)),
            ("robotsPolicy:value", ~F.col("robots_policy").isin("RESPECT", "IGNORE")),
        ),
    ).drop("_again")
