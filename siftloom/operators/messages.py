"""Channel messages: selection, media rules, artifacts, replies and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import files as FN
from siftloom.functions import urls
from siftloom.operators.skew import attach_per_key, top_per_group

#: fragments of a media type and the extension they stand for, in order (fixed values)
MIME_FRAGMENTS = [
    ("pdf", ".pdf"), ("epub", ".epub"), ("mobi", ".mobi"), ("azw", ".mobi"), ("fb2", ".fb2"),
    ("djvu", ".djvu"), ("mp3", ".mp3"), ("wav", ".wav"), ("ogg", ".ogg"), ("flac", ".flac"),
    ("json", ".json"), ("parquet", ".parquet"), ("csv", ".csv"), ("word", ".docx"),
    ("docx", ".docx"), ("zip", ".zip"), ("rar", ".rar"), ("7z", ".7z"),
    ("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/webp", ".webp"), ("image/gif", ".gif"),
    ("video/mp4", ".mp4"), ("video/webm", ".webm"), ("text/plain", ".txt"), ("text/html", ".html"),
]


def latest_messages(messages: DataFrame, limit: int = 500, since: Column | None = None) -> DataFrame:
    """Newest ``limit`` messages of each channel, not older than ``since``."""
    recent = top_per_group(
        messages, ["channel"], [F.desc("message_id")], limit, spread=F.col("message_id")
    )
    return recent if since is None else recent.where(F.col("ts").isNull() | (F.col("ts") >= since))


def media_extension(name: Column, mime: Column) -> Column:
    by_name = F.nullif(F.lower(urls.extension_of(F.coalesce(name, F.lit("")))), F.lit(""))
    by_mime = F.when(F.lit(False), "")
    for fragment, ext in MIME_FRAGMENTS:
        by_mime = by_mime.when(F.lower(mime).contains(fragment), ext)
    return F.coalesce(by_name, by_mime)


def message_artifacts(
    messages: DataFrame,
    download_media: bool = True,
    include_kinds: Sequence[str] = (),
    allowed_extensions: Sequence[str] = (),
    save_records: bool = False,
) -> DataFrame:
    """Up to two artifacts per message, with distinct URLs: its media and its record.

    Audio is dropped.  A row yields its own artifacts, so nothing is shuffled.
    """
    exts = [e.lower() if e.startswith(".") else "." + e.lower() for e in allowed_extensions]
    kind = F.when(F.col("media_kind") != "audio", F.col("media_kind"))
    url = F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), "message_id")
    ext = media_extension(F.col("media_name"), F.col("media_mime"))
    named = F.concat(FN.sanitize_filename(FN.stem_of(F.col("media_name"))), F.lower(urls.extension_of(F.col("media_name"))))
    unnamed = F.concat(kind, F.lit("_"), "message_id", F.coalesce(ext, F.lit("")))
    wanted = F.lit(download_media) & kind.isNotNull()
    if include_kinds:
        wanted = wanted & kind.isin(list(include_kinds))
    if exts:
        wanted = wanted & (ext.isNull() | ext.isin(exts))
    record = F.to_json(
        F.struct(
            "message_id", "channel", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
            F.coalesce("text", F.lit("")).alias("text"), "sender_id", "views", "forwards",
            F.col("reply_to_id").alias("reply_to_msg_id"), kind.isNotNull().alias("has_media"), kind.alias("media_kind"),
        )
    )
    media = F.struct(
        F.lit("media").alias("artifact"), url.alias("url"),
        F.when(F.col("media_name").isNotNull(), named).otherwise(unnamed).alias("file_name"),
        ext.alias("extension"), F.lit(None).cast("string").alias("body"),
    )
    note = F.struct(
        F.lit("record").alias("artifact"), F.concat(url, F.lit("#message")).alias("url"),
        F.concat(F.col("message_id").cast("string"), F.lit(".json")).alias("file_name"),
        F.lit(".json").alias("extension"), record.alias("body"),
    )
    keep_record = F.lit(save_records or ".json" in exts)
    artifacts = F.filter(
        F.array(F.when(F.coalesce(wanted, F.lit(False)), media), F.when(keep_record, note)), lambda a: a.isNotNull()
    )
    return messages.select("channel", "message_id", F.explode(artifacts).alias("a")).select(
        "channel", "message_id", "a.*", F.sha2("a.body", 256).alias("sha256")
    )


def resolve_replies(messages: DataFrame) -> DataFrame:
    """Messages with the text and sender of the message they answer.

    The key (channel, message id) is unique on the right, so a hot channel spreads over
    its message ids; replies to one very popular message are met by broadcast.
    """
    target = messages.select(
        "channel", F.col("message_id").alias("reply_to_id"),
        F.col("text").alias("reply_text"), F.col("sender_id").alias("reply_sender"),
    )
    open_rows = messages.where("reply_to_id IS NULL").withColumns(
        {"reply_text": F.lit(None).cast("string"), "reply_sender": F.lit(None).cast(messages.schema["sender_id"].dataType)}
    )
    replies = messages.where("reply_to_id IS NOT NULL")
    counts = replies.groupBy("channel", "reply_to_id").agg(F.count("*").alias("_n"))
    answered = attach_per_key(replies, target.join(counts, ["channel", "reply_to_id"]), ["channel", "reply_to_id"], ["message_id"])
    return answered.select(*messages.columns, "reply_text", "reply_sender").unionByName(open_rows)


def channel_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("media_kind").isNotNull() & (F.col("media_kind") != "audio")).alias("media"),
        F.sum("views").alias("views"),
        F.sum("forwards").alias("forwards"),
        F.max("message_id").alias("last_message"),
        F.lit(1).alias("pages_crawled"),
    )
