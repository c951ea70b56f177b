"""Time segments and speech-record projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions import urls


def segments(duration: Column, window: float) -> Column:
    """array<struct<chunk_index,start_s,end_s,duration_s>>; the last window is clipped."""
    count = F.ceil(duration / window).cast("int")
    indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    start = lambda i: i * F.lit(float(window))
    end = lambda i: F.least((i + 1) * F.lit(float(window)), duration)
    return F.transform(
        indexes,
        lambda i: F.struct(
            i.alias("chunk_index"),
            F.bround(start(i), 2).alias("start_s"),
            F.bround(end(i), 2).alias("end_s"),
            F.bround(end(i) - start(i), 2).alias("duration_s"),
        ),
    )


def stt_records(df: DataFrame) -> DataFrame:
    """Speech-to-text records from a segments table."""
    speaker = F.when(F.coalesce("speaker", F.lit("")) == "", "Speaker").otherwise(F.col("speaker"))
    return df.select(
        "medium_id",
        "chunk_index",
        F.concat("title", F.format_string("_chunk_%03d", "chunk_index")).alias("chunk_id"),
        urls.basename(F.col("audio_file")).alias("audio_filename"),
        F.col("start_s").alias("start_seconds"),
        F.col("end_s").alias("end_seconds"),
        F.bround(F.col("end_s") - F.col("start_s"), 2).alias("duration_seconds"),
        "transcript",
        speaker.alias("speaker"),
        "language",
        F.col("title").alias("source_title"),
        "source_url",
    )


def tts_records(stt: DataFrame) -> DataFrame:
    """Text-to-speech prompts from speech-to-text records."""
    return stt.select(
        F.col("chunk_id").alias("id"),
        F.col("transcript").alias("text_prompt"),
        F.col("audio_filename").alias("audio_reference"),
        "duration_seconds",
        F.col("speaker").alias("speaker_id"),
    )


def transcript_line() -> Column:
    return F.format_string(
        "[%.1fs - %.1fs] %s: %s", "start_seconds", "end_seconds", "speaker", "transcript"
    )


def transcript_parts(stt: DataFrame, part_size: int = 500) -> DataFrame:
    """Transcript of every medium in chunk order, in parts of ``part_size`` chunks.

    A part never holds more than ``part_size`` lines, so a very long medium is
    spread over many groups; the parts in order are the whole transcript.
    """
    part = F.floor(F.col("chunk_index") / part_size).cast("long")
    lines = F.array_sort(F.collect_list(F.struct("chunk_index", transcript_line().alias("line"))))
    return (
        stt.groupBy("medium_id", part.alias("part_no"))
        .agg(
            F.first("source_title").alias("title"),
            F.first("source_url").alias("source_url"),
            F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
        )
    )


def chain_segments(segments: DataFrame, block: int = 1000) -> DataFrame:
    """Start and end of each segment from the durations before it.

    Durations are summed per block of ``block`` chunks first; offsets inside a
    block then need that block only.  The window over blocks is ``block`` times
    shorter than one over segments.
    """
    blocked = segments.withColumn("_b", F.floor(F.col("chunk_index") / block).cast("long"))
    sums = blocked.groupBy("medium_id", "_b").agg(F.sum("duration_s").alias("_sum"))
    before = Window.partitionBy("medium_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "medium_id", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_offset")
    )
    inside = Window.partitionBy("medium_id", "_b").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.withColumn("_run", F.sum("duration_s").over(inside)).join(offsets, ["medium_id", "_b"])
    end = F.col("_offset") + F.col("_run")
    return placed.withColumns({"start_s": end - F.col("duration_s"), "end_s": end}).drop("_b", "_run", "_offset")
